"""Guides of repositories, with a stand-in for the model, and normalised lists."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import guides, repos
from tesserine.plans.staging import staged
from tesserine.queries.registry import query, table
from tesserine.queries.retrieval import _CHUNKS, _MODULES, _VOTED, _chunks, _top


def _describes():
    """A stand-in for the guides' model. It gives no overview to full prompts about names of even length, nor at all about names that end in 3."""

    def reply(prompt: str) -> str:
        name, files = re.search(r"Repository: (.*)", prompt)[1], re.search(r"\nFiles: (.*)", prompt)[1]
        if name.endswith("3") or (len(name) % 2 == 0 and "\nFolders:" in prompt):
            return json.dumps({"overview": " "})
        return "```json\n" + json.dumps({"overview": f"{name} starts with {files.split(', ')[0]}", "key_flows": [f"step {n}" for n in range(1, 11)], "entrypoints": ["a", "A ", "b"], "languages": []}) + "\n```"

    return lambda prompts: [reply(p) for p in prompts]


def _guides(spark, sf_dir):
    packs = staged(repos.guide_pack(_chunks(spark, sf_dir)), "packs")
    return staged(guides.written(packs, spark.createDataFrame([], guides.GUIDE), _describes, F.to_timestamp(F.lit("2024-01-01"))), "guides")


_FIRST = f"(SELECT repo_id, first(rel_path ORDER BY score DESC, rel_path) AS f FROM (SELECT repo_id, rel_path, round(sqrt(sum(length(coalesce(text, '')))) + sum(len(symbols)), 6) AS score FROM {_CHUNKS} GROUP BY 1, 2) GROUP BY 1)"
_LANE = "CASE WHEN repo_id LIKE '%3' THEN 'failed' WHEN length(repo_id) % 2 = 0 THEN 'compact' ELSE 'full' END"
_GUIDES = f"""SELECT repo_id, lane, CASE WHEN lane <> 'failed' THEN repo_id || ' starts with ' || f END AS overview, CASE WHEN lane <> 'failed' THEN '- step 1' || chr(10) || '- step 2' || chr(10) || '- step 3' || chr(10) || '- step 4' || chr(10) || '- step 5' || chr(10) || '- step 6' || chr(10) || '- step 7' || chr(10) || '- step 8' END AS key_flows,
  CASE WHEN lane <> 'failed' THEN 'a, b' END AS entrypoints, CASE WHEN lane <> 'failed' THEN coalesce(l.v, '') END AS languages, CASE WHEN lane <> 'failed' THEN coalesce(replace(m.v, '|', ', '), '') END AS modules
  FROM (SELECT DISTINCT repo_id, {_LANE} AS lane FROM {_CHUNKS}) LEFT JOIN {_FIRST} USING (repo_id) LEFT JOIN {_top(_VOTED, 'lang', 3)} l USING (repo_id) LEFT JOIN {_top(_MODULES(_VOTED), 'm', 8)} m USING (repo_id)"""


@query(_GUIDES)
def repo_guides(spark, sf_dir):
    """Guides of every repository: full prompts, compact ones where the reply is of no use, lists of the pack where it gives none."""
    return _guides(spark, sf_dir).select("repo_id", "lane", "overview", "key_flows", "entrypoints", F.array_join("languages", "|").alias("languages"), "modules")


@query(f"SELECT doc_id, lane IS NOT NULL AND lane <> 'failed' AS found, coalesce(overview, '') AS overview, coalesce(modules, '') AS modules FROM documents LEFT JOIN ({_GUIDES}) ON source = repo_id")
def guides_fetched(spark, sf_dir):
    """The guide of each document's repository; missing ones are told apart."""
    stored = guides.merged(spark.createDataFrame([], guides.GUIDE), _guides(spark, sf_dir))
    wanted = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_id"))
    return guides.fetched(wanted, stored).select("doc_id", "found", "overview", "modules")


@query("""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda x: regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: length(x) > 0)[1:40] AS w FROM documents),
  u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM t)
  SELECT doc_id, coalesce(string_agg(x, '|' ORDER BY i), '') AS terms FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, arg_min(x, i) AS x, min(i) AS i FROM u GROUP BY doc_id, lower(x)) USING (doc_id) GROUP BY doc_id""")
def normalized_lists(spark, sf_dir):
    """Terms of a list, cut before they are made distinct by lower case, in first-seen order."""
    docs = table(spark, sf_dir, "documents")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return docs.select("doc_id", F.array_join(T.normalized_list(words, 40), "|").alias("terms"))
