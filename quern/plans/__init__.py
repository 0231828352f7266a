"""The compression plan: options, score providers, engine and registered queries."""
