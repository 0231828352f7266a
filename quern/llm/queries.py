"""One query per operator: the whole table, production parameters, the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, bpe, exact_dedup, html_text, mixing, ngram_join, pii, quality, secrets, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Where the word-level vocabulary of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: The production mix: two thirds of the tokens there are; German and Spanish weigh more than their
#: share and the one large source less, so that leaves run short and pass on what they can't take.
PRODUCTION_MIX = mixing.Mix(
    weights={("hub",): 0.2, ("curated",): 0.35, ("web",): 0.45, ("*", "en"): 0.55, ("*", "de"): 0.2, ("*", "es"): 0.15, ("*", "fr"): 0.1},
    share=0.66,
    max_epochs=2,
    seed=17,
)


def domain_of(source):
    """The domain of a source's name: ``src0`` is the hub, numbers below 8 are curated, others web."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"^src([0-9]{1,9})$", 1)
    return F.when(number == "0", "hub").when((number != "") & (F.length(number) == 1) & (number < "8"), "curated").otherwise("web")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.select(docs, PRODUCTION_MIX, domain_of(F.col("source")), F.col("lang"), F.col("source"), mixing.word_count(F.col("text")))
    return mix.withColumnRenamed("id", "doc_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(secrets.joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.joined_spans(F.col("spans")).alias("spans"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *(n(k) for k in pii.KINDS[:-1]), F.sha2(pii.joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined_spans(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _mix_sql(mix: mixing.Mix) -> str:
    """The allotment by levels (the largest of (amount - rooms before) / weights from here on) and the sorted prefix of each leaf.
    All weights of the mix are positive."""

    def weight(*path: str) -> str:
        rank = {True: 0, False: 1}
        cases = []
        for key, w in sorted(mix.weights.items(), key=lambda x: rank["*" not in x[0]]):
            if len(key) == len(path):
                cases.append(f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(path, key, strict=True) if v != '*')} THEN {w}::DOUBLE")
        return f"CASE {' '.join(cases)} ELSE {mix.default}::DOUBLE END" if cases else f"{mix.default}::DOUBLE"

    def handed(name: str, nodes: str, parent: str, path: list[str]) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""{name}w AS (SELECT *, {weight(*path)} AS w FROM {nodes}),
        {name}l AS (SELECT *, (amount - coalesce(sum(room) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}w WINDOW v AS ({by} ORDER BY room / w, {', '.join(path)})),
        {name} AS (SELECT * EXCLUDE (amount, w, level), least(room, greatest(max(level) OVER ({by}), 0) * w) AS given FROM {name}l)"""

    return rf"""
        WITH n AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS n_tokens,
                CASE WHEN source = 'src0' THEN 'hub' WHEN regexp_full_match(source, 'src[0-7]') THEN 'curated' ELSE 'web' END AS domain FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens)::DOUBLE * {mix.max_epochs} AS room FROM n GROUP BY ALL),
        d0 AS (SELECT domain, sum(room) AS room, {mix.share}::DOUBLE * (SELECT sum(tokens) FROM leaves)::DOUBLE AS amount FROM leaves GROUP BY 1),
        {handed("d", "d0", "", ["domain"])},
        g0 AS (SELECT x.domain, x.lang, x.room, d.given AS amount FROM (SELECT domain, lang, sum(room) AS room FROM leaves GROUP BY 1, 2) x JOIN d USING (domain)),
        {handed("g", "g0", "domain", ["domain", "lang"])},
        s0 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.room, g.given AS amount FROM leaves l JOIN g ON l.domain = g.domain AND l.lang = g.lang),
        {handed("s", "s0", "domain, lang", ["domain", "lang", "source"])},
        p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN floor(given + 1e-6)::BIGINT // tokens ELSE {mix.max_epochs} END AS epochs, CASE WHEN tokens > 0 THEN floor(given + 1e-6)::BIGINT % tokens ELSE 0 END AS rest FROM s),
        o AS (SELECT n.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(md5('{mix.seed}:' || epochs || ':' || doc_id), 1, 13), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM n JOIN p USING (domain, lang, source))
        SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::INT AS copies FROM o"""


def _matches_sql(kind: str, k: int, pattern: str, holds: str) -> str:
    """Leftmost matches with the text before each: the lengths add up to places."""
    part = lambda group: f"regexp_extract_all(t, '(?s)(.*?)({pattern})', {group})"
    return f"""SELECT * FROM (SELECT doc_id, {k} AS k, '{kind}' AS kind, m, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS a, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e
          FROM (SELECT doc_id, unnest({part(1)}) AS gap, unnest({part(2)}) AS m, unnest(range(len({part(2)}))) AS i FROM d)) WHERE {holds}"""


def _pii_sql(disclosure: float = pii.DISCLOSURE, support: int = pii.SUPPORT) -> str:
    """Base spans and disclosing terms, without the operator's bounds on which pairs are made: every pair of an entity
    and a word of its texts is weighed."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digits}[length({digits}) - i]::INT WHEN {digits}[length({digits}) - i]::INT > 4 THEN {digits}[length({digits}) - i]::INT * 2 - 9 ELSE {digits}[length({digits}) - i]::INT * 2 END)) % 10 = 0"
    octets = "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0"
    base = " UNION ALL ".join(
        _matches_sql(kind, k, pattern, holds)
        for k, (kind, pattern, holds) in enumerate(
            (
                ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
                ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", octets),
                ("card", r"[0-9](?:[ -]?[0-9])+", f"length({digits}) BETWEEN 12 AND 19 AND {luhn}"),
                ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
            )
        )
    )
    word = r"[\p{L}\p{N}]+"
    weighed = r"^\p{L}{" + str(pii.LEAST_LETTERS) + r",}$|^\p{Lu}|\p{N}|[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"
    line = "string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k, e)"
    n = "count(*) FILTER (WHERE kind = '{0}') AS n_{0}"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        base AS MATERIALIZED ({base}),
        uncovered AS (SELECT doc_id, k, a, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY a, k, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM (SELECT doc_id, k, a, e FROM base UNION ALL SELECT doc_id, 9, length(t), length(t) FROM d WHERE doc_id IN (SELECT doc_id FROM base))),
        outside AS (SELECT doc_id, any_value(t) AS t, string_agg(substr(t, was + 1, greatest(a - was, 0)), ' ' ORDER BY a, k) AS s FROM uncovered JOIN d USING (doc_id) GROUP BY 1),
        words AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(t), '{word}'), lambda w: length(w) > 1)) AS term FROM d),
        counts AS (SELECT term, count(*) AS n_term FROM words GROUP BY 1),
        candidates AS (SELECT DISTINCT t, unnest(list_transform(list_filter(regexp_extract_all(s, '{word}'), lambda w: length(w) > 1 AND regexp_matches(w, '{weighed}')), lambda w: lower(w))) AS term FROM outside),
        mentions AS (SELECT t, m AS entity, count(DISTINCT doc_id) AS n FROM base JOIN d USING (doc_id) GROUP BY 1, 2),
        known AS (SELECT entity, sum(n)::DOUBLE AS n_entity FROM mentions GROUP BY 1 HAVING count(*) >= {support} AND sum(n) < (SELECT count(*) FROM d)),
        pairs AS (SELECT entity, term, sum(n)::DOUBLE AS n_both FROM mentions JOIN known USING (entity) JOIN candidates USING (t) GROUP BY 1, 2 HAVING count(*) >= {support}),
        terms AS (SELECT DISTINCT term FROM pairs JOIN known USING (entity) JOIN counts USING (term), (SELECT count(*)::DOUBLE AS n_all FROM d) WHERE log2(n_both * n_all / (n_term * n_entity)) / log2(n_all / n_entity) >= {disclosure}::DOUBLE),
        marked AS ({_matches_sql("term", len(pii.KINDS) - 1, word, "lower(m) IN (SELECT term FROM terms)")}),
        every AS (SELECT * FROM base UNION ALL SELECT * FROM marked),
        b AS (SELECT doc_id, {", ".join(n.format(k) for k in pii.KINDS[:-1])}, {line} AS spans FROM base GROUP BY 1),
        s AS (SELECT doc_id, {line} AS spans, count(*) AS n_spans FROM every GROUP BY 1)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS[:-1])}, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(s.spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_ann": op2_ann,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_html": op6_html,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    # all pairs that share a 5-gram, so for small tables only
    "op1_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS c FROM g GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y, k = na.c AND k = nb.c AS same FROM p JOIN n na ON x = na.doc_id JOIN n nb ON y = nb.doc_id WHERE k::DOUBLE / (na.c + nb.c - k) >= 0.8::DOUBLE),
        e AS (SELECT x AS a, y AS b, same FROM l UNION ALL SELECT y, x, same FROM l),
        r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a),
        c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY 1),
        k AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (WHERE same) AS n_copies FROM e GROUP BY 1)
        SELECT c.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 0) AS n_copies FROM c LEFT JOIN k USING (doc_id)""",
    # every window of 400 bytes, so for small tables only
    "op3_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT doc_id, list_transform(range(octet_length(b) - 399), lambda i: hash(array_slice(b, i + 1, i + 400))) AS hs FROM d WHERE octet_length(b) >= 400),
        h AS (SELECT doc_id, unnest(range(len(hs))) AS s, unnest(hs) AS h FROM w),
        r AS (SELECT doc_id, s FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
        m AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS opens FROM r),
        i AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM m),
        u AS (SELECT doc_id, run, min(s) AS a, max(s) + 400 AS e FROM i GROUP BY 1, 2),
        k AS (SELECT u.doc_id, a AS place, hex(array_slice(b, coalesce(lag(e) OVER (PARTITION BY u.doc_id ORDER BY a), 0) + 1, a)) AS x FROM u JOIN d USING (doc_id)
              UNION ALL SELECT d.doc_id, octet_length(b) + 1, hex(array_slice(b, coalesce(m.e, 0) + 1, octet_length(b))) FROM d LEFT JOIN (SELECT doc_id, max(e) AS e FROM u GROUP BY 1) m USING (doc_id)),
        t AS (SELECT doc_id, sha256(unhex(string_agg(x, '' ORDER BY place))) AS kept_sha256 FROM k GROUP BY 1),
        c AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM u GROUP BY 1),
        ws AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ws FROM documents),
        wh AS (SELECT doc_id, unnest(range(len(ws) - 49)) AS s, unnest(list_transform(range(len(ws) - 49), lambda i: hash(ws[i + 1 : i + 50]))) AS h FROM ws WHERE len(ws) >= 50),
        wr AS (SELECT doc_id, s FROM wh QUALIFY count(*) OVER (PARTITION BY h) > 1),
        wn AS (SELECT doc_id, sum(least(50, n - s))::BIGINT AS n_passage_words FROM (SELECT doc_id, s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), s + 50) AS n FROM wr) GROUP BY 1)
        SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256, coalesce(n_passage_words, 0) AS n_passage_words
        FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN wn USING (doc_id)""",
    "op4_mixing": _mix_sql(PRODUCTION_MIX),
    # of the template that the test pages have
    "op6_html": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
        b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(?:p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS h FROM a),
        c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
        SELECT page_id, url, text, length(text) AS n_chars FROM c""",
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
        h AS (SELECT doc_id, sha256(n) AS text_sha256 FROM t)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_pii": _pii_sql(),
}
