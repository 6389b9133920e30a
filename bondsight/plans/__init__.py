"""Registered queries, each with its SQL twin where SQL can say it."""

from bondsight.plans import corpus, evaluation, merge, more, rating, reading, reports, statements, streams

PARTS = (rating, merge, evaluation, reports, corpus, reading, more, statements, streams)
QUERIES = {name: query for part in PARTS for name, query in part.R.queries.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.R.oracles.items()}
