"""Annotations against human labels: validity, precision, agreement, per-class measures; and the annotator interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.stats import cohen_kappa, wilson
from stemma.functions.text import json_object
from stemma.schemas import LABEL_RECORD

# The roles and areas a label may have.
ROLES = ("ai_method", "ai_application", "not_ai")
AREAS = ("genomics_transcriptomics", "protein_structure_design", "drug_discovery", "gene_editing_synbio", "clinical_genomics", "other")

PROMPT = (
    "Label the scientific paper below. Answer with one JSON object and nothing else. Its keys: "
    'ai_role (ai_method if a method of machine learning is developed or adapted, ai_application if existing ones are applied, '
    "not_ai if they play no part), bio_area (one of {areas}), biosecurity (true for pathogens, toxins or other dual use), "
    "rationale (one sentence).\n\nTitle: {title}\nAbstract: {abstract}"
)


def valid_role(c):
    """The role if it is one of ROLES, else 'invalid', also for null."""
    return F.when(c.isin(*ROLES), c).otherwise("invalid")


def prompts(works: DataFrame) -> DataFrame:
    """(work_id, prompt); the abstract's first 3500 characters are shown."""
    head, rest = PROMPT.replace("{areas}", ", ".join(f'"{a}"' for a in AREAS)).split("{title}")
    mid, tail = rest.split("{abstract}")
    text = F.concat(F.lit(head), F.coalesce("title", F.lit("")), F.lit(mid), F.substring(F.coalesce("abstract", F.lit("")), 1, 3500), F.lit(tail))
    return works.select("work_id", text.alias("prompt"))


def annotate(requests: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """(work_id, answer) by any function of the prompt; a call that fails leaves its row out, to be asked again later."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = []
            for w, q in zip(p["work_id"], p["prompt"]):
                try:
                    got.append((w, answer(q)))
                except Exception:  # noqa: BLE001 - any failure of a remote annotator skips the row
                    continue
            yield pd.DataFrame(got, columns=["work_id", "answer"])

    return requests.mapInPandas(run, "work_id string, answer string")


def parse_answers(answers: DataFrame) -> DataFrame:
    """Label rows of (work_id, answer): the JSON object inside the answer; answers without one are left out."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LABEL_RECORD if f.name != "work_id")
    r = answers.select("work_id", F.from_json(json_object(F.col("answer")), f"{fields}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    r = r.where("r is not null and r._corrupt is null")
    return r.select("work_id", *[F.col(f"r.{f.name}") for f in LABEL_RECORD if f.name != "work_id"]).withColumn("ai_role", valid_role(F.col("ai_role")))


def _share(df: DataFrame, name: str, hit) -> DataFrame:
    s = df.agg(F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).alias("k"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return s.select(F.lit(name).alias("metric"), (F.col("k") / F.nullif("n", F.lit(0))).alias("value"), lo.alias("ci_low"), hi.alias("ci_high"), "n")


def label_metrics(labels: DataFrame) -> list[DataFrame]:
    """Precision of the corpus query by the labels; the stricter ones only where their columns exist."""
    ai = F.coalesce(F.col("ai_role") != "not_ai", F.lit(True))  # 'invalid' counts as a hit
    out = [_share(labels, "query_precision_llm", ai)]
    if "off_topic" in labels.columns:
        out.append(_share(labels, "query_precision_ai_and_bio", ai & ~F.coalesce("off_topic", F.lit(False))))
    if "biosecurity" in labels.columns:
        out.append(_share(labels, "share_biosecurity_relevant", F.coalesce("biosecurity", F.lit(False))))
    return out


def gold_metrics(labels: DataFrame, gold: DataFrame) -> list[DataFrame]:
    """Agreement, kappa, and precision and recall per role, over the works with a valid human label."""
    m = gold.where(F.col("human_ai_role").isin(*ROLES)).select("work_id", "human_ai_role").join(labels.select("work_id", "ai_role"), "work_id")
    nul = F.lit(None).cast("double")
    k = cohen_kappa(m, "human_ai_role", "ai_role").select(F.lit("cohen_kappa").alias("metric"), F.col("kappa").alias("value"), nul.alias("ci_low"), nul.alias("ci_high"), "n")
    sums = []
    for r in ROLES:
        p, a = F.col("ai_role") == r, F.col("human_ai_role") == r
        sums += [F.count(F.when(p & a, 1)).alias(f"tp_{r}"), F.count(F.when(p, 1)).alias(f"p_{r}"), F.count(F.when(a, 1)).alias(f"a_{r}")]
    one = m.agg(*sums)  # all counts in one pass
    cells = ", ".join(f"'precision_{r}', tp_{r}, p_{r}, 'recall_{r}', tp_{r}, a_{r}" for r in ROLES)
    per = one.selectExpr(f"stack({2 * len(ROLES)}, {cells}) as (metric, tp, n)")
    per = per.select("metric", (F.col("tp") / F.nullif("n", F.lit(0))).alias("value"), nul.alias("ci_low"), nul.alias("ci_high"), "n")
    return [_share(m, "agreement_with_human", F.col("human_ai_role") == F.col("ai_role")), k, per]


def evaluation(labels: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(metric, value, ci_low, ci_high, n) of all measures that the columns allow."""
    parts = label_metrics(labels) + (gold_metrics(labels, gold) if gold is not None else [])
    return reduce(DataFrame.unionByName, parts)


def confusion(labels: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows: human role; columns: the labels' roles; counts."""
    m = gold.select("work_id", "human_ai_role").join(labels.select("work_id", "ai_role"), "work_id")
    return m.groupBy("human_ai_role").pivot("ai_role", [*ROLES, "invalid"]).count().na.fill(0)
