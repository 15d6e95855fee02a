"""The seam to models: batched calls from partitions with deadlines and retries, and offline stand-ins.

A model is a plain function from a list of inputs to a list of outputs. It is called where the
rows are, in batches, each attempt under a deadline if one is given, and tried again with a growing
pause; a batch that keeps failing fails its task, which Spark tries again elsewhere. With ``default``
given, its rows get that instead; with ``failed`` given, its rows are asked one by one and those
that still fail keep their error in that column.

An ``AnswerTable`` keeps answers by the hash of what was asked, so that a plan that is run again,
or another row with the same prompt, does not ask again.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import json_text
from quarryline.sources import store

EMBED_BATCH = 100
DIMENSIONS = 64


class ModelError(RuntimeError):
    """A model that failed at every attempt; ``raw`` has its last answer, if it gave one."""

    def __init__(self, message: str, raw: str | None = None):
        super().__init__(message)
        self.raw = raw


class ModelTimeout(ModelError):
    pass


def with_retry(call: Callable, attempts: int = 3, pause: Callable[[int, Exception], float] | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried up to ``attempts`` times; pauses are 2**n s after a timeout and 1 s after other errors by default."""
    pause = pause or (lambda n, e: 2.0**n if isinstance(e, TimeoutError) else 1.0)

    def tried(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except Exception as e:
                if n + 1 == attempts:
                    raise (ModelTimeout if isinstance(e, TimeoutError) else ModelError)(f"failed {attempts} times: {e}", getattr(e, "raw", None)) from e
                sleep(pause(n, e))

    return tried


def with_deadline(call: Callable, seconds: float | None) -> Callable:
    """``call`` given up after so many seconds with a TimeoutError; what hangs is left behind on its own thread."""
    if seconds is None:
        return call

    def timed(*args):
        box: list = []

        def run():
            try:
                box.append((True, call(*args)))
            except BaseException as e:
                box.append((False, e))

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        thread.join(seconds)
        if not box:
            raise TimeoutError(f"no answer within {seconds:g} s")
        done, value = box[0]
        if not done:
            raise value
        return value

    return timed


def batched(model: Callable[[list], list], size: int) -> Callable[[list], list]:
    """``model`` on batches of at most ``size``; as many outputs as inputs, or an error."""

    def run(items: list) -> list:
        out: list = []
        for i in range(0, len(items), size):
            part = items[i : i + size]
            found = list(model(part))
            if len(found) != len(part):
                raise ModelError(f"{len(found)} outputs for {len(part)} inputs")
            out += found
        return out

    return run


def map_model(
    df: DataFrame, model: Callable[[list], list], *, column: str, out: str, kind: str, size: int = EMBED_BATCH, attempts: int = 3, default=None, deadline: float | None = None, failed: str | None = None
) -> DataFrame:
    """``df`` with the model's output for ``column`` as ``out`` of SQL type ``kind``; a null input has a null output."""
    fresh = [out] + [failed] * (failed is not None)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in fresh), f"`{out}` {kind}", *(f"`{failed}` string" for _ in fresh[1:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        timed = with_deadline(batched(model, size), deadline)
        call, once = with_retry(timed, attempts), with_retry(timed, 1)

        def answers(asked: list) -> tuple[list, list]:
            if not asked:
                return [], []
            try:
                return call(asked), [None] * len(asked)
            except ModelError as e:
                if failed is None:
                    if default is None:
                        raise
                    return [default] * len(asked), []
                if len(asked) == 1:
                    return [default], [str(e)]
            parts = []
            for one in asked:
                try:
                    parts.append((once([one])[0], None))
                except ModelError as e:
                    parts.append((default, str(e)))
            return [v for v, _ in parts], [e for _, e in parts]

        for pdf in batches:
            pdf = pdf.drop(columns=fresh, errors="ignore")
            some = pdf[column].notna()
            new: dict = {name: pd.Series([None] * len(pdf), index=pdf.index, dtype=object) for name in fresh}
            for i in range(0, int(some.sum()), size):
                at = pdf.index[some][i : i + size]
                for name, values in zip(fresh, answers(pdf.loc[at, column].tolist()), strict=False):
                    new[name].loc[at] = pd.Series(values, index=at, dtype=object)
            yield pdf.assign(**new)

    return df.mapInPandas(run, schema)


class AnswerTable:
    """Answers of text models by role and hash of the prompt, in a folder that outlives a run."""

    def __init__(self, spark, folder: str, *, deadline: float | None = 30.0, attempts: int = 3, size: int = 16):
        self.spark, self.folder, self.how = spark, folder.rstrip("/"), {"deadline": deadline, "attempts": attempts, "size": size}

    def known(self, role: str) -> DataFrame:
        path = f"{self.folder}/{role}"
        kind = "hash string, answer string, error string"
        return self.spark.read.schema(kind).parquet(path) if store.exists(self.spark, path) else self.spark.createDataFrame([], kind)

    def ask(self, rows: DataFrame, prompt: Column, model: Callable[[list], list], role: str, out: str = "answer") -> DataFrame:
        """``rows`` with the model's answer to each one's prompt; null for a null prompt and where the model failed.

        Only prompts that have no answer yet are asked, once each; what failed is written with its error and asked again
        by the next call."""
        keyed = rows.withColumn("__ql_hash", F.sha2(prompt, 256)).withColumn("__ql_prompt", prompt)
        new = keyed.where(F.col("__ql_prompt").isNotNull()).select(F.col("__ql_hash").alias("hash"), F.col("__ql_prompt").alias("prompt")).dropDuplicates(["hash"])
        new = new.join(self.known(role).where("error IS NULL").select("hash"), "hash", "left_anti")
        said = map_model(new, model, column="prompt", out="answer", kind="string", failed="error", **self.how)
        said.select("hash", "answer", "error").write.mode("append").parquet(f"{self.folder}/{role}")
        got = self.known(role).where("error IS NULL").groupBy(F.col("hash").alias("__ql_hash")).agg(F.max("answer").alias(out))
        return keyed.drop("__ql_prompt", out).join(got, "__ql_hash", "left").drop("__ql_hash")


def hashed_embedding(texts: list[str], dim: int = DIMENSIONS) -> list[list[float]]:
    """A stand-in embedder: signed counts of hashed words, at unit length; no words give a zero vector."""
    import zlib

    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % dim] += 1 if h >> 16 & 1 else -1
        norm = np.sqrt((out[i] ** 2).sum())
        out[i] /= norm if norm else 1.0
    return out.tolist()


def embed_documents(chunks: DataFrame, model: Callable[[list], list] = hashed_embedding, *, text: str = "text", name: str = "hashed", **seam) -> DataFrame:
    """Chunks with ``vector`` and ``model_name``; vectors stay in their chunk's row, so none can be paired wrongly."""
    return map_model(chunks, model, column=text, out="vector", kind="array<float>", **seam).withColumn("model_name", F.lit(name))


def embed_queries(queries: DataFrame, model: Callable[[list], list] = hashed_embedding, *, text: str = "text", **seam) -> DataFrame:
    """Questions, stripped, with ``vector``; an empty one is an error, as there is nothing to embed."""
    said = F.trim(F.coalesce(F.col(text), F.lit("")))
    asked = queries.withColumn(text, F.when(said == "", F.raise_error(F.lit("an empty question can't be embedded"))).otherwise(said))
    return map_model(asked, model, column=text, out="vector", kind="array<float>", **seam)


def json_field(answer: Column, path: str, kind: str, default) -> Column:
    """A field of a model's JSON answer, or the default if the answer or the field can't be read."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json_text(answer)), f"$.{path}", kind), F.lit(default).cast(kind))


def token_totals(calls: DataFrame) -> DataFrame:
    """(calls, prompt_tokens, completion_tokens, total_tokens) over a table of model calls."""
    total = F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0))
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), total.alias("total_tokens"))


def default_json(value) -> str:
    """Canonical JSON of a plain value: keys sorted, sets as sorted lists, what JSON lacks as text."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (set, frozenset)):
            return sorted((plain(x) for x in v), key=str)
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v if isinstance(v, (str, int, float, bool, type(None))) else str(v)

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False)
