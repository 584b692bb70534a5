"""Result lists for readers: tiers, groups, funnels, evidence and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scoring import relevance_of, tier, tier_bar

# Labels of features and tiers, texts of the summary.
LABELS = {
    "relevance": "相关性判定", "filter": "相关性判定", "keyword_coverage": "关键词覆盖", "llm": "LLM 判定", "blended": "综合得分", "normalized": "跨意图归一", "embedding": "语义相似度", "citation": "引用影响力", "recency": "时效性", "venue": "发表场所", "title": "标题命中",
}
HIDDEN = ("normalized", "blended", "impact_skipped")
TIERS = ("highly_relevant", "partially_relevant")
LEADS = {"highly_relevant": "入选「高度相关」", "partially_relevant": "入选「部分相关」"}


def with_tiers(ranked: DataFrame, override: float | None = None) -> DataFrame:
    """ranked (score, features, intent) with relevance and tier."""
    bar = tier_bar(F.col("intent"), None if override is None else F.lit(float(override)))
    return ranked.withColumn("relevance", relevance_of(F.col("features"))).withColumn("tier", tier(F.col("score"), F.col("relevance"), bar))


def percent(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("int")


def top_features(features: Column, most: int = 3) -> Column:
    """The largest positive features as `label n%`, derived ones left out; equal ones in their order."""
    entries = F.transform(F.map_entries(F.coalesce(features, F.create_map().cast("map<string,double>"))), lambda e, i: F.struct((-e["value"]).alias("neg"), i.alias("i"), e["key"].alias("key"), e["value"].alias("value")))
    kept = F.filter(entries, lambda e: ~e["key"].isin(*HIDDEN) & ~e["key"].endswith("_skipped") & (e["value"] > 0) & ~F.isnan(e["value"]))

    def label(e: Column) -> Column:
        name = e["key"]
        for k, v in LABELS.items():
            name = F.when(e["key"] == k, F.lit(v)).otherwise(name)
        return F.concat(name, F.lit(" "), percent(e["value"]).cast("string"), F.lit("%"))

    return F.transform(F.slice(F.array_sort(kept), 1, most), label)


def model_reason(reason: Column) -> Column:
    """The sentence a model gave, out of the recorded reason; '' if there is none."""
    bare = F.regexp_replace(F.trim(F.coalesce(reason, F.lit(""))), r"(?i);?\s*impact\[[^\]]*\]\s*$", "")
    said = F.regexp_extract(bare, r"(?is)^(?:expanded_)?llm\s*:\s*[0-9.]+\s*;\s*(.+)$", 1)
    return F.regexp_replace(F.trim(said), r"[;\s]+$", "")


def selection_reason(reason: Column, features: Column, tier_name: Column, intent: Column, topic: Column, method: Column) -> Column:
    """Why a paper is shown: the model's sentence, else what its slots and features say."""
    lead = F.lit("入选结果列表")
    for name, text in LEADS.items():
        lead = F.when(tier_name == name, F.lit(text)).otherwise(lead)
    feature = lambda k: F.try_element_at(features, F.lit(k))
    relevance = F.coalesce(feature("relevance"), feature("llm"), feature("keyword_coverage"))
    bits = F.array_compact(
        F.array(
            F.when(F.coalesce(topic, F.lit("")) != "", F.concat(F.lit("与主题「"), topic, F.lit("」相关"))),
            F.when(F.coalesce(method, F.lit("")) != "", F.concat(F.lit("方法线索「"), method, F.lit("」"))),
            F.when(feature("title") >= 0.5, F.lit("标题关键词命中较高")),
            F.when(relevance > 0, F.concat(F.lit("相关性约 "), percent(relevance).cast("string"), F.lit("%"))),
            F.when(feature("citation") >= 0.7, F.lit("引用影响力突出")),
        )
    )
    rest = F.when(F.size(bits) > 0, F.array_join(bits, "；")).otherwise(F.concat(F.lit("综合排序通过（intent="), F.coalesce(intent, F.lit("broad")), F.lit("）")))
    said = model_reason(reason)
    return F.when(said != "", F.concat(lead, F.lit("："), said)).otherwise(F.concat(lead, F.lit("："), rest, F.lit("。")))


def groups(tiered: DataFrame) -> DataFrame:
    """qid, tier, n, paper_ids: both tiers of every question, their papers in order of sel_rank. Selections are bounded, so are the lists."""
    every = tiered.select("qid").distinct().withColumn("tier", F.explode(F.array(*[F.lit(t) for t in TIERS])))
    lists = tiered.groupBy("qid", "tier").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sel_rank", "paper_id"))), lambda x: x["paper_id"]), ",").alias("paper_ids"))
    return every.join(lists, ["qid", "tier"], "left").fillna(0, ["n"]).fillna("", ["paper_ids"])


def funnel(retrieved: DataFrame, passed: DataFrame, tiered: DataFrame) -> DataFrame:
    """qid and the numbers of papers retrieved, filtered, ranked, and in either tier; 0 where a stage has none."""
    stages = retrieved.select("qid", F.lit("retrieved").alias("s")).unionByName(passed.select("qid", F.lit("filtered").alias("s"))).unionByName(tiered.select("qid", F.lit("ranked").alias("s"))).unionByName(tiered.select("qid", F.col("tier").alias("s")))
    return stages.groupBy("qid").agg(*[F.count_if(F.col("s") == x).alias(f"n_{x}") for x in ("retrieved", "filtered", "ranked", *TIERS)])


def summary(funnel_row: DataFrame) -> DataFrame:
    """funnel() rows with intent, top_title and n_edges: qid, summary."""
    high, part, got = F.col("n_highly_relevant"), F.col("n_partially_relevant"), F.col("n_retrieved")
    parts = F.concat_ws(
        "，", F.concat(F.lit("意图识别为 "), F.coalesce("intent", F.lit("broad"))), F.when(got > 0, F.concat(F.lit("多源召回 "), got.cast("string"), F.lit(" 篇候选"))),
        F.concat(F.lit("经过滤与排序后给出 "), (high + part).cast("string"), F.lit(" 篇")), F.when(high > 0, F.concat(F.lit("其中高度相关 "), high.cast("string"), F.lit(" 篇"))), F.when(part > 0, F.concat(F.lit("部分相关 "), part.cast("string"), F.lit(" 篇"))),
    )
    top = F.when(F.coalesce("top_title", F.lit("")) != "", F.concat(F.lit(" 最相关："), F.col("top_title"))).otherwise(F.lit(""))
    edges = F.when(F.coalesce("n_edges", F.lit(0)) > 0, F.concat(F.lit(" 引用关系图含 "), F.col("n_edges").cast("string"), F.lit(" 条边。"))).otherwise(F.lit(""))
    return funnel_row.select("qid", F.concat(parts, F.lit("。"), top, edges).alias("summary"))
