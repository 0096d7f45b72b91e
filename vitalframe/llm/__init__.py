"""Training-data pipeline operators (quality, dedup, packing, licences, mixing, WARC, rules,
nearest neighbours, language, token counts).  Nothing else in the library imports this package."""
