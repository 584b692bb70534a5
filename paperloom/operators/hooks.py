"""Places where a model is called: judging, encoding, rewriting.

The model is a callable that is shipped with the task and made once per task; the engine
batches, parses, clips and joins. Rows are cut to the top k before any call, and what fails
or can't be parsed leaves the scores as they were. The stubs are deterministic.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.scoring import clip
from paperloom.functions.text import loose_json, squeeze

Backend = Callable[[str], str | None]


def first_reply(*backends: Backend) -> Backend:
    """One backend out of several: the first that returns text; one that fails is passed over. None if all do."""

    def call(prompt: str) -> str | None:
        for backend in backends:
            try:
                if reply := backend(prompt):
                    return reply
            except Exception:  # noqa: BLE001, S112
                continue
        return None

    return call


def stub_judge(prompt: str) -> str:
    """Scores out of a digest of question and paper, as fenced JSON."""
    asked = json.loads(prompt)
    rows = [{"paper_id": p["paper_id"], "score": int(hashlib.md5((asked["question"] + p["paper_id"]).encode()).hexdigest()[:4], 16) / 65535, "reason": "stub"} for p in asked["papers"]]
    return "```json\n" + json.dumps(rows) + "\n```"


def replies(rows: DataFrame, model: Backend, batch: int = 8) -> DataFrame:
    """qid, batch, ids, reply: the model's reply to each batch of a question's papers (qid, question, paper_id, title, k_rank). Failures reply null."""
    groups = rows.withColumn("batch", F.floor((F.col("k_rank") - 1) / batch).cast("int")).groupBy("qid", "batch").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("k_rank", "paper_id", "title"))).alias("papers"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for qid, n, question, papers in zip(df.qid, df.batch, df.question, df.papers, strict=True):
                listed = [{"paper_id": p["paper_id"], "title": p["title"]} for p in papers]
                try:
                    reply = model(json.dumps({"question": question or "", "papers": listed}))
                except Exception:  # noqa: BLE001
                    reply = None
                out.append((qid, n, [p["paper_id"] for p in listed], reply))
            yield pd.DataFrame(out, columns=["qid", "batch", "ids", "reply"])

    return groups.mapInPandas(run, "qid string, batch int, ids array<string>, reply string")


def json_scores(replied: DataFrame) -> DataFrame:
    """qid, paper_id, llm, llm_reason out of replies: a JSON array of paper_id, score and reason, fenced or among other text.

    Unknown ids and scores that are no numbers are dropped, scores clipped to [0, 1]; of repeats the last stays.
    """
    found = F.from_json(loose_json(F.col("reply"), "[", "]"), "array<struct<paper_id:string,score:string,reason:string>>")
    rows = replied.select("qid", "batch", "ids", F.posexplode(found).alias("i", "x")).where(F.array_contains("ids", F.col("x.paper_id")))
    rows = rows.select("qid", F.col("x.paper_id").alias("paper_id"), F.struct("batch", "i").alias("place"), clip(F.col("x.score").try_cast("double")).alias("llm"), F.trim(F.coalesce("x.reason", F.lit(""))).alias("llm_reason")).where(F.col("x.score").try_cast("double").isNotNull())
    last = rows.groupBy("qid", "paper_id").agg(F.max_by(F.struct("llm", "llm_reason"), "place").alias("b"))
    return last.select("qid", "paper_id", "b.llm", "b.llm_reason")


def judge(scored: DataFrame, model: Backend = stub_judge, top_k: int = 15, batch: int = 8, score: str = "keyword_coverage") -> DataFrame:
    """json_scores() of the first top_k papers of each question by score, above 0. Rows are cut before the model is called."""
    order = Window.partitionBy("qid").orderBy(F.col(score).desc(), "cord")
    top = scored.where(F.col(score) > 0).select("qid", "question", "paper_id", "title", score, "cord").withColumn("k_rank", F.row_number().over(order)).where(F.col("k_rank") <= top_k)
    return json_scores(replies(top, model, batch))


def stub_encoder(texts: list[str], size: int = 16) -> list[list[float]]:
    """Vectors of hashed words."""
    out = np.zeros((len(texts), size))
    for row, t in enumerate(texts):
        for word in t.lower().split():
            out[row, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % size] += 1.0
    return out.tolist()


def encode(rows: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]] = stub_encoder, batch: int = 32, most: int = 1800) -> DataFrame:
    """text, vector of the distinct texts of a column, white space squeezed, cut at `most` characters for the encoder. Blank texts have none; a batch that fails has none."""
    texts = rows.select(F.left(squeeze(F.col(text)), F.lit(most)).alias("text")).where("text <> ''").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                try:
                    vectors = encoder(part.column(0).to_pylist())
                except Exception:  # noqa: BLE001
                    continue
                if len(vectors) == part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["text", "vector"])

    return texts.mapInArrow(run, "text string, vector array<double>")


def ask(rows: DataFrame, prompt: str, model: Backend) -> DataFrame:
    """prompt, reply: the model's reply to each distinct prompt of a column; null where it fails. Null prompts aren't asked."""
    prompts = rows.select(F.col(prompt).alias("prompt")).where("prompt is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                try:
                    out.append(model(p))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["prompt", "reply"])

    return prompts.mapInArrow(run, "prompt string, reply string")


def stub_reader(question: str) -> str:
    """A reading of a question: its words as one term, fenced."""
    return "```json\n" + json.dumps({"intent": "method", "topic": question.strip(" ?"), "term_groups": [{"canonical": question.strip(" ?"), "variants": [question.lower()]}]}) + "\n```"


def stub_rephraser(question: str) -> str:
    """Phrasings of a question as a JSON array: itself, its words turned round, and a longer one."""
    words = question.strip(" ?").split()
    return json.dumps([question, " ".join(words[::-1]), " ".join([*words[: len(words) // 2], "approaches", "overview", "recent", "progress"])])
