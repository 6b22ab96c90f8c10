"""All queries of the library, without those of its subpackages."""

from covey.plans import files, statistics, structure

QUERIES = {**structure.QUERIES, **statistics.QUERIES, **files.QUERIES}
SQL = {**structure.SQL, **statistics.SQL, **files.SQL}
