"""The jobs as queries: each runs its job twice into one new folder and reads the result."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession

from arborspark.plans import portable as P
from arborspark.queries import fitch_sql, informative_sql, mask_sql
from arborspark.storage import shared_folder

from . import alignment_report, language_quartets
from .common import settings


def job1_alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on all alignments, as it stands after a rerun."""
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        alignment_report.run(spark, sf_dir, folder, **settings(alignment_report.__file__))
    return spark.read.parquet(folder)


def _job1_sql() -> str:
    o = settings(alignment_report.__file__)
    taxa, states = o["taxa"], o["states"]
    masks = mask_sql(taxa, "month", states)
    gap = (1 << states + 1) - 1
    sizes = f"with {masks} select msa_id, sum(weight)::bigint as n_sites, sum(weight * len(list_filter(masks, lambda m: m = {gap}))) as n_gaps from pats group by 1"
    return f"""
select msa_id, {taxa}::bigint as n_taxa, s.n_sites, i.n_patterns, i.n_informative, round(n_gaps / ({taxa} * s.n_sites)::double, 6) as gap_share, parsimony_offset, loglik,
       case when i.n_informative >= {o["least_informative"]} then 'ok' else 'uninformative' end as status, (msa_id % {o["shards"]})::int as shard
from ({sizes}) s join ({informative_sql(taxa, "month")}) i using (msa_id) join ({fitch_sql(taxa, "month")}) f using (msa_id) join ({P.duckdb(P.SCORE_JC)}) l using (msa_id)
"""


def job2_language_quartets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of every source after two runs, of which the second finds nothing new."""
    folder = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        language_quartets.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/state", f"{folder}/report", **settings(language_quartets.__file__))
    return spark.read.schema("tree int, split string, n_words long, n_patterns long, n_informative long, loglik double, best boolean, source string").parquet(f"{folder}/report")


def _job2_sql() -> str:
    o = settings(language_quartets.__file__)
    taxa = o["taxa"]
    names, listed = ", ".join(taxa), ", ".join(f"'{t}'" for t in taxa)
    each = ", ".join(f"coalesce(max(case when lang = '{t}' then st end), 0) as {t}" for t in taxa)
    scored = []
    for number, mate in enumerate(language_quartets.TREES, 1):
        tree, split = language_quartets.quartet(taxa, mate, o["branch"])
        ctes, last = P.jc_ctes(tree)
        scored.append(f"select source, {number}::int as tree, '{split}' as split, ll from (with {ctes} select source, round(sum(weight * ln(greatest(like_, 1e-300))), 6) as ll from {last} group by source)")
    twice = " + ".join(f"((({' + '.join(f'({t} = {k})::int' for t in taxa)}) >= 2)::int)" for k in range(4))
    return rf"""
with w as (
  select source, lang, unnest(list_distinct(list_filter(string_split_regex(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{language_quartets.APART}'), lambda x: x <> ''))) as word
  from documents where lang in ({listed})
), n as (select source, lang, word, count(*) as n from w group by all),
cols as (select source, word, {each} from (select *, case when n = 1 then 1 when n < {o["often"]} then 2 else 3 end as st from n) group by source, word),
pats as (select source, {names}, count(*) as weight from cols group by all),
facts as (select source, sum(weight)::bigint as n_words, count(*) as n_patterns, sum(case when {twice} >= 2 then weight else 0 end)::bigint as n_informative from pats group by source),
scored as ({" union all ".join(scored)})
select s.source, tree, split, n_words, n_patterns, n_informative, ll as loglik, row_number() over (partition by s.source order by ll desc, tree) = 1 as best
from scored s join facts f on s.source is not distinct from f.source
"""


QUERIES = {f.__name__: f for f in (job1_alignment_report, job2_language_quartets)}
SQL = {"job1_alignment_report": _job1_sql(), "job2_language_quartets": _job2_sql()}
