"""Budget, selection and trimming of scored sentences, one sample a row.

Arrays ``sentences``, ``n_tokens`` and ``scores`` run in parallel. All operators are folds and filters
over a row's arrays: no shuffle, however many samples there are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import mandatory
from quern.functions.tokens import TokenCounter, loaded

_INTS = "array<int>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def bind(body, *values: Column) -> Column:
    """``body`` of several values, each computed once. The optimizer puts a column's expression where
    the column stands, inside a lambda too, where it would run once for each element; a bound value
    does not move."""
    packed = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return let(packed, lambda row: body(*(row[f"v{i}"] for i in range(len(values)))))


def places(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast(_INTS))


def total(n_tokens: Column) -> Column:
    return F.aggregate(n_tokens, F.lit(0), lambda a, x: a + x)


def resolve_budget(n_total: Column, target: Column, rate: Column) -> Column:
    """``target`` if it is positive, at most the total; else the total times ``1 - rate``, cut off."""
    return F.when(target > 0, F.least(target, n_total)).otherwise((n_total.cast("double") * (F.lit(1.0) - rate.cast("double"))).cast("int"))


def standing(score: Column) -> Column:
    """What a score is ranked by: its value in units of 1e-12. Sums that differ only by the rounding of doubles are ties."""
    return F.round(score * F.lit(1e12))


def ranked(scores: Column) -> Column:
    """Indexes by score, best first, ties to the lower index."""
    pairs = F.transform(scores, lambda s, i: F.struct((-standing(s)).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def mandatory_places(sentences: Column, context_type: Column) -> Column:
    return F.filter(places(sentences), lambda i: mandatory(F.element_at(sentences, i + 1), context_type))


def select_budget(sentences: Column, n_tokens: Column, scores: Column, target: Column, separator_tokens: Column, context_type: Column) -> Column:
    """Indexes kept under a token budget, ascending.

    Mandatory sentences come first, in order, each skipped if it doesn't fit. Then the ranking is taken
    until the first sentence that doesn't fit. A separator is paid for by each but the first. If
    nothing fits the best sentence is kept."""
    return bind(_select_budget, sentences, n_tokens, scores, target, separator_tokens, context_type)


def _select_budget(sentences, n_tokens, scores, target, separator_tokens, context_type):
    nothing = F.struct(F.lit(0).alias("used"), F.lit(False).alias("stop"), F.array().cast(_INTS).alias("kept"))

    def cost(acc, i):
        return acc["used"] + F.element_at(n_tokens, i + 1) + F.when(F.size(acc["kept"]) > 0, separator_tokens).otherwise(0)

    def skip(acc, i):
        fits = cost(acc, i) <= target
        return F.struct(F.when(fits, cost(acc, i)).otherwise(acc["used"]).alias("used"), acc["stop"].alias("stop"), F.when(fits, F.concat(acc["kept"], F.array(i))).otherwise(acc["kept"]).alias("kept"))

    def until(acc, i):
        """How many of the ranking fit: numbers only, so that a long one costs no copies."""
        cost = acc["used"] + F.element_at(n_tokens, i + 1) + F.when(acc["n"] + acc["before"] > 0, separator_tokens).otherwise(0)
        fits = ~acc["stop"] & (cost <= target)
        return F.struct(F.when(fits, cost).otherwise(acc["used"]).alias("used"), (~fits).alias("stop"), (acc["n"] + fits.cast("int")).alias("n"), acc["before"].alias("before"))

    def choose(order):
        must = F.aggregate(mandatory_places(sentences, context_type), nothing, skip)

        def rest(first):
            left = F.array_except(order, first["kept"])
            start = F.struct(first["used"].alias("used"), F.lit(False).alias("stop"), F.lit(0).alias("n"), F.size(first["kept"]).alias("before"))
            taken = lambda o: F.concat(first["kept"], F.slice(o, 1, F.aggregate(o, start, until, lambda acc: acc["n"])))
            return let(left, taken)

        return let(let(must, rest), lambda k: F.when(F.size(k) > 0, F.array_sort(k)).otherwise(F.slice(order, 1, 1)))

    return F.when(F.size(scores) == 0, F.array().cast(_INTS)).otherwise(let(ranked(scores), choose))


def select_threshold(sentences: Column, scores: Column, threshold: Column, context_type: Column) -> Column:
    """Indexes of scores at or above the threshold and of mandatory sentences; the best one if none."""
    return bind(_select_threshold, sentences, scores, threshold, context_type)


def _select_threshold(sentences, scores, threshold, context_type):
    above = F.filter(places(scores), lambda i: (F.element_at(scores, i + 1) >= threshold) | mandatory(F.element_at(sentences, i + 1), context_type))
    return F.when(F.size(scores) == 0, F.array().cast(_INTS)).otherwise(let(above, lambda k: F.when(F.size(k) > 0, k).otherwise(F.slice(ranked(scores), 1, 1))))


def join_kept(sentences: Column, kept: Column, separator: Column) -> Column:
    return bind(lambda s, k, sep: F.call_function("array_join", F.transform(F.array_sort(k), lambda i: F.element_at(s, i + 1)), sep), sentences, kept, separator)


def estimated_tokens(n_tokens: Column, kept: Column, separator_tokens: Column) -> Column:
    """Tokens of kept sentences and of the separators between them."""
    some = lambda n, k, sep: F.aggregate(k, F.lit(0), lambda a, i: a + F.element_at(n, i + 1)) + (F.size(k) - 1) * sep
    return bind(lambda n, k, sep: F.when(F.size(k) == 0, 0).otherwise(some(n, k, sep)), n_tokens, kept, separator_tokens)


def drop_order(sentences: Column, scores: Column, kept: Column, context_type: Column) -> Column:
    """In which order kept sentences go: lowest score first, ties to the lower index, mandatory last."""
    keyed = F.transform(kept, lambda i: F.struct(mandatory(F.element_at(sentences, i + 1), context_type).alias("m"), standing(F.element_at(scores, i + 1)).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def trim(sentences: Column, n_tokens: Column, scores: Column, kept: Column, target: Column, separator: Column, separator_tokens: Column, context_type: Column, counter: TokenCounter, order: Column | None = None) -> Column:
    """Kept indexes after the joined text has been held against the budget.

    Nothing changes for a budget of 0 or less, a single sentence, or a text that fits. Else sentences go
    in ``drop_order`` until both the estimate and the count of the joined text fit, or one is left. Counters in
    Python want the ``order`` as a column that is already computed."""
    if not counter.native:
        return _trim_in_python(counter)(sentences, n_tokens, kept, target, separator, separator_tokens, drop_order(sentences, scores, kept, context_type) if order is None else order)
    return bind(lambda *v: _trim(*v, counter), sentences, n_tokens, scores, kept, target, separator, separator_tokens, context_type)


def _trim(sentences, n_tokens, scores, kept, target, separator, separator_tokens, context_type, counter):
    fits = lambda k: counter.count(join_kept(sentences, k, separator)) <= target

    def cut(order):
        left = lambda m: F.array_sort(F.slice(order, m + 1, F.size(order)))
        last = F.size(order) - 1

        def less(acc, i):
            """The estimate falls with each sentence dropped, so the first fit is found by a running sum."""
            tokens, at = acc["tokens"] - F.element_at(n_tokens, i + 1), acc["at"] + 1
            ok = (acc["m"] == 0) & (at <= last) & (tokens + (last - at) * separator_tokens <= target)
            return F.struct(tokens.alias("tokens"), at.alias("at"), F.when(ok, at).otherwise(acc["m"]).alias("m"))

        everything = F.struct(F.aggregate(order, F.lit(0), lambda a, i: a + F.element_at(n_tokens, i + 1)).alias("tokens"), F.lit(0).alias("at"), F.lit(0).alias("m"))
        estimated = F.aggregate(order, everything, less, lambda acc: acc["m"])
        first = lambda found, m: F.when(found > 0, found).when(fits(left(m)), m).otherwise(0)
        enough = let(estimated, lambda m0: F.when(m0 == 0, 0).otherwise(F.aggregate(F.sequence(m0, last), F.lit(0), first)))
        return let(enough, lambda m: left(F.when(m > 0, m).otherwise(last)))

    return F.when((target <= 0) | (F.size(kept) <= 1), kept).otherwise(F.when(fits(kept), kept).otherwise(let(drop_order(sentences, scores, kept, context_type), cut)))


def _trim_in_python(counter):
    """``trim`` for counters that are not Column expressions: the same steps, in Arrow batches."""
    import pandas as pd

    path = counter.path

    def run(sentences, n_tokens, kept, target, separator, sep_tokens, order):
        tok = loaded(path)
        out = []
        for s, n, k, t, sep, c, o in zip(sentences, n_tokens, kept, target, separator, sep_tokens, order, strict=True):
            if k is None:
                out.append(None)
                continue
            k = list(k)
            count = lambda idx: len(tok.encode(sep.join(s[i] for i in sorted(idx)), add_special_tokens=False).ids)  # noqa: B023, E731
            if t > 0 and len(k) > 1 and count(k) > t:
                o = list(o)
                for m in range(1, len(o)):
                    k = o[m:]
                    if sum(n[i] for i in k) + (len(k) - 1) * c <= t and count(k) <= t:
                        break
            out.append(sorted(k))
        return pd.Series(out)

    return F.pandas_udf(run, _INTS, F.PandasUDFType.SCALAR)
