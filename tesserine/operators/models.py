"""Model calls behind injected factories, with caches, retries and validation.

A factory is a picklable function without arguments that builds the model; it runs once per
task. A model takes a list of texts and returns one result a text, so a lost executor repeats
only the batches of its own tasks.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.text import has_secret

Factory = Callable[[], Callable[[list[str]], list]]


def with_retries(call: Callable[[str], str], attempts: int = 3, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """The call, tried again after wait, 2 wait, 4 wait, ...; the last error is raised."""

    def tried(prompt: str) -> str:
        for n in range(attempts):
            try:
                return call(prompt)
            except Exception:
                if n + 1 == attempts:
                    raise
                sleep(wait * 2**n)
        raise ValueError("attempts must be positive")

    return tried


def _attempt(model: Callable[[list[str]], list], texts: list[str], caps: Sequence[int]) -> list[tuple[list[float] | None, int | None, str | None]]:
    """(vector, cap, error) of each text. A window that fails is halved until the texts that fail stand alone; those go on to the next cap."""
    out: list[tuple[list[float] | None, int | None, str | None]] = [(None, None, "no cap")] * len(texts)
    left = list(range(len(texts)))
    for cap in caps:
        failed, parts = [], [left] if left else []
        while parts:
            part = parts.pop()
            try:
                vectors = model([texts[i][:cap] for i in part])
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                for i, v in zip(part, vectors, strict=True):
                    out[i] = ([float(x) for x in v], cap, None)
            except Exception as e:  # the error is a column of the result
                if len(part) == 1:
                    out[part[0]] = (None, None, f"{type(e).__name__}: {e}"[:200])
                    failed.append(part[0])
                else:
                    parts += [part[len(part) // 2 :], part[: len(part) // 2]]
        left = sorted(failed)
    return out


def embed(rows: DataFrame, factory: Factory, text: str = "text", caps: Sequence[int] = (30_000, 8_000, 4_000, 2_000), window: int = 32) -> DataFrame:
    """The rows with embedding, cap and error.

    A text that fails is tried again cut shorter, alone; cap is the limit in characters that its
    vector was made under. When all caps fail, the row carries the error and no vector. Null text
    counts as empty. Columns of these names are replaced.
    """
    from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructType

    rows = rows.drop("embedding", "cap", "error")
    schema = StructType([*rows.schema.fields]).add("embedding", ArrayType(FloatType())).add("cap", IntegerType()).add("error", StringType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or factory()
            for at in range(0, len(frame), window):
                part = frame.iloc[at : at + window].copy()
                done = _attempt(model, [t or "" for t in part[text]], caps)
                for n, column in enumerate(("embedding", "cap", "error")):
                    part[column] = pd.Series([d[n] for d in done], index=part.index, dtype="Int32" if column == "cap" else object)
                yield part

    return rows.mapInPandas(run, schema)


def json_object(reply: str | None) -> dict | None:
    """The JSON object of a reply, with a code fence or words around it or without; None if there is none."""
    body = reply or ""
    begin, end = body.find("{"), body.rfind("}")
    try:
        found = json.loads(body[begin : end + 1]) if 0 <= begin < end else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _replies(model: Callable[[list[str]], list], prompts: list[str], attempts: int, wait: float) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt. A window that fails is halved, so that only the prompts that fail are tried again, after wait, 2 wait, 4 wait, ..."""
    try:
        replies = model(prompts)
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies for {len(prompts)} prompts")
        return [(r, None) for r in replies]
    except Exception as e:  # the error is a column of the result
        if len(prompts) > 1:
            half = len(prompts) // 2
            return _replies(model, prompts[:half], attempts, wait) + _replies(model, prompts[half:], attempts, wait)
        if attempts > 1:
            time.sleep(wait)
            return _replies(model, prompts, attempts - 1, 2 * wait)
        return [(None, f"{type(e).__name__}: {e}"[:200])]


def ask_json(rows: DataFrame, factory: Factory, prompts: Sequence[str], required: str, attempts: int = 3, wait: float = 0.5, window: int = 32) -> DataFrame:
    """The rows with reply (JSON text), step and error.

    The prompt columns are asked in turn until a reply is a JSON object whose ``required`` field
    is text that isn't blank; step is the number of that prompt. Rows answered by one prompt
    don't see the next, and a null prompt is passed over. A call that fails is tried again alone; the last error
    is kept where no prompt got an answer. Columns of these names are replaced.
    """
    from pyspark.sql.types import IntegerType, StringType, StructType

    rows = rows.drop("reply", "step", "error")
    schema = StructType([*rows.schema.fields]).add("reply", StringType()).add("step", IntegerType()).add("error", StringType())

    def answers(model: Callable[[list[str]], list], part: pd.DataFrame) -> list[tuple[str | None, int | None, str | None]]:
        out: list[tuple[str | None, int | None, str | None]] = [(None, None, "no prompt")] * len(part)
        for step, column in enumerate(prompts, 1):
            texts = part[column]
            left = [i for i, (reply, *_) in enumerate(out) if reply is None and isinstance(texts.iloc[i], str)]
            for i, (reply, error) in zip(left, _replies(model, [texts.iloc[i] for i in left], attempts, wait) if left else [], strict=True):
                found = json_object(reply)
                good = found is not None and isinstance(found.get(required), str) and found[required].strip() != ""
                out[i] = (json.dumps(found), step, None) if good else (None, None, error or "invalid reply")
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or factory()
            for at in range(0, len(frame), window):
                part = frame.iloc[at : at + window].copy()
                done = answers(model, part)
                for n, column in enumerate(("reply", "step", "error")):
                    part[column] = pd.Series([d[n] for d in done], index=part.index, dtype="Int32" if column == "step" else object)
                yield part

    return rows.mapInPandas(run, schema)


def decision(reply: str | None) -> tuple[int, str] | None:
    """(score 0 to 4, reason of up to 100 characters) of a JSON reply; None if it isn't one."""
    try:
        parsed = json.loads(reply or "")
        score = parsed["score"]
    except (ValueError, KeyError, TypeError):
        return None
    if isinstance(score, bool) or not isinstance(score, int) or not 0 <= score <= 4:
        return None
    return score, str(parsed.get("why", ""))[:100]


def filter_scores(rows: DataFrame, factory: Factory, key: str = "id", prompt: str = "prompt", text: str = "text") -> DataFrame:
    """(key, filter_score, why). A text with a secret scores 0 and never reaches the model; a reply that isn't valid is asked for once more, then scores 0."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or factory()
            results = [decision(r) for r in model(list(frame[prompt]))]
            again = [i for i, r in enumerate(results) if r is None]
            for i, r in zip(again, model([frame[prompt].iloc[i] for i in again]) if again else [], strict=True):
                results[i] = decision(r)
            done = [r or (0, "invalid reply") for r in results]
            yield pd.DataFrame({key: frame[key], "filter_score": pd.Series([s for s, _ in done], index=frame.index, dtype="int32"), "why": [w for _, w in done]})

    secret = F.coalesce(has_secret(F.col(text)), F.lit(False))
    scored = rows.where(~secret).select(key, prompt).mapInPandas(run, f"{key} {kind}, filter_score int, why string")
    return scored.unionByName(rows.where(secret).select(key, F.lit(0).alias("filter_score"), F.lit("secret").alias("why")))


def rerank(pool: DataFrame, factory: Factory | None, query: str = "query_id", key: str = "id", pair: str = "pair_text", most: int = 128) -> DataFrame:
    """The pool with rerank_score and rerank_rank. Rows past ``most`` by rank aren't scored and follow the scored ones in retriever order; without a model that order stays."""
    from pyspark.sql import Window
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*pool.schema.fields]).add("rerank_score", DoubleType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or factory()
            yield frame.assign(rerank_score=[float(s) for s in model([t or "" for t in frame[pair]])])

    if factory is None:
        scored = pool.withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        rest = pool.where(F.col("rank") > most).withColumn("rerank_score", F.lit(None).cast("double"))
        scored = pool.where(F.col("rank") <= most).mapInPandas(run, schema).unionByName(rest)
    order = Window.partitionBy(query).orderBy(F.desc_nulls_last("rerank_score"), "rank", key)
    return scored.withColumn("rerank_rank", F.row_number().over(order))


def messages(system: str, question: Column, evidence: Column, closing: str) -> Column:
    """A chat of four messages: instructions, question, evidence, closing request."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", question), turn("user", evidence), turn("user", F.lit(closing)))


def cached(keys: DataFrame, cache: DataFrame, now: Column, key: str = "cache_key") -> DataFrame:
    """The rows with ``hit`` and the cached ``value``: the newest entry of the key, if it has not expired. An entry without expires_at lasts for ever."""
    entry = cache.groupBy(key).agg(F.max_by(F.struct("value", "expires_at"), "created_at").alias("e"))
    live = F.col("e").isNotNull() & (F.col("e.expires_at").isNull() | (F.col("e.expires_at") > now))
    return keys.join(entry, key, "left").withColumn("hit", live).withColumn("value", F.when(live, F.col("e.value"))).drop("e")
