"""All registered queries and their SQL."""

from queries import definitions, json, lake, loads, names, tables, text

MODULES = [lake, tables, text, json, names, definitions, loads]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
