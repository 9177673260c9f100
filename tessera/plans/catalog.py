"""All registered queries of the package."""

from tessera.plans import files, parsing, reports, rows, whole
from tessera.plans.base import on
from tessera.plans.curation import split_report
from tessera.plans.parsing import clean_sql
from tessera.plans.reports import split_sql

FLAGSHIP = (
    on("documents")(split_report),
    f"""WITH k AS (SELECT max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY md5({clean_sql('text')})), s AS ({split_sql(rows='k')}), c AS (SELECT lang, split, count(*) AS n FROM s GROUP BY 1, 2)
 SELECT lang, split, n, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY lang), 1) AS pct FROM c""",
)
QUERIES = {"split_report": FLAGSHIP, **reports.QUERIES, **rows.QUERIES, **parsing.QUERIES, **whole.QUERIES, **files.QUERIES}
