"""All queries on the reference's operators and their SQL."""

from tracelake.plans import files, oracles, queries

QUERIES = queries.QUERIES | files.QUERIES
ORACLES = oracles.ORACLES | files.ORACLES
