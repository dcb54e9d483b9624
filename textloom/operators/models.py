"""Embedding and generation behind caches, limits and retries (EM-*, GN-*, CON-*, JN-19, SET-1).

A model is any object with ``embed(texts)`` or ``complete(system, user)``; it is made
once per partition.  What a cache table holds is joined; only the distinct misses reach
the model, in Arrow batches of ``batch_size``.  The offline models need no network.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from bisect import bisect_left
from collections.abc import Callable, Iterable
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

REFUSAL_SENTENCE = "The provided sources do not contain this information."
SYSTEM_PROMPT = "\n".join(
    [
        "Answer from the numbered sources only.",
        f"If they do not hold the answer, reply exactly: {REFUSAL_SENTENCE}",
        "Say so when a question assumes something the sources do not support.",
        "Give numbers, units and ranges as they stand in the sources.",
        "Cite sources by number, such as [1].",
        "Be brief.",
    ]
)


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Completer(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class RetryError(RuntimeError):
    """A call failed after all its retries; a saving cache has the rounds before, so run again to resume."""


class RateLimiter:
    """CON-4: at most so many requests and tokens in any 60 seconds.

    The log holds the time of each request and the tokens up to it, so the moment at which
    the next one fits is looked up, not waited for in small steps.
    """

    def __init__(self, requests: int, tokens: int | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, window: float = 60.0) -> None:
        self.requests, self.tokens, self.clock, self.sleep, self.window = requests, tokens, clock, sleep, window
        self.times: list[float] = []
        self.sums = [0]

    def free_at(self, tokens: int) -> float:
        """When a request of so many tokens fits."""
        over = [self.clock()]
        if len(self.times) >= self.requests:
            over.append(self.times[-self.requests] + self.window)
        if self.tokens is not None:
            k = bisect_left(self.sums, self.sums[-1] + tokens - self.tokens)  # so many of the oldest must be over
            over += [self.times[k - 1] + self.window] if k else []
        return max(over)

    def acquire(self, tokens: int = 0) -> None:
        if self.tokens is not None and tokens > self.tokens:
            raise ValueError(f"{tokens} tokens never fit a limit of {self.tokens} a minute")
        wait = self.free_at(tokens) - self.clock()
        if wait > 0:
            self.sleep(wait)
        self.times.append(self.clock())
        self.sums.append(self.sums[-1] + tokens)
        old = max(0, len(self.times) - 10 * self.requests)
        del self.times[:old], self.sums[:old]


def with_retries(call: Callable[[], Any], retryable: Callable[[Exception], bool], retries: int = 5, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> Any:
    """CON-5: try again after random pauses of up to 2, 4, 8, ... seconds."""
    draw = (rng or random).uniform
    pauses = [draw(0, 2.0**k) for k in range(1, retries + 1)]
    while True:
        try:
            return call()
        except Exception as e:
            if not retryable(e):
                raise
            if not pauses:
                raise RetryError(f"no answer in {retries + 1} tries: {e}") from e
        sleep(pauses.pop(0))


def transient(error: Exception) -> bool:
    """Rate limits, lost connections and server errors, but not a quota for the day."""
    code = getattr(error, "code", None) or getattr(error, "status_code", None)
    if code == 429:
        return "perday" not in re.sub(r"[\s_-]", "", str(error)).lower()
    return isinstance(error, (ConnectionError, TimeoutError)) or isinstance(code, int) and 500 <= code < 600


class HashingEmbedder:
    """Offline: signed feature hashing of word and character trigrams, unit length."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                for gram in {word, *(f"{word}_"[k : k + 3] for k in range(len(word) - 1))}:
                    h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
                    row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        return out


class ExtractiveCompleter:
    """Offline: the source sentence with most of the question's words, or the refusal."""

    def complete(self, system: str, user: str) -> str:
        sources, _, question = user.rpartition("\n\nQuestion: ")
        asked = {w for w in re.findall(r"\w+", question.lower()) if len(w) > 3}
        best, number = (0, 0, ""), 0
        for line in sources.split("\n"):
            head = re.fullmatch(r"\[(\d+)\]", line.strip())
            if head:
                number = int(head.group(1))
                continue
            for sentence in re.split(r"(?<=[.!?])\s+", line):
                shared = len(asked & set(re.findall(r"\w+", sentence.lower())))
                if shared > best[0]:
                    best = (shared, number, sentence.strip())
        return f"{best[2]} [{best[1]}]" if best[0] >= 2 else REFUSAL_SENTENCE


def _post(url: str, body: dict, headers: dict[str, str], timeout: float = 120) -> dict:
    import json
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as response:  # noqa: S310 - configured endpoint
        return json.load(response)


class GeminiEmbedder:
    """CON-1: one content per text; counts and dimensions are checked."""

    def __init__(self, model: str, dimensions: int, key: str, base: str = "https://generativelanguage.googleapis.com/v1beta") -> None:
        self.model, self.dimensions, self.key, self.base = model, dimensions, key, base

    def embed(self, texts: list[str]) -> np.ndarray:
        name = f"models/{self.model}"
        requests = [{"model": name, "content": {"parts": [{"text": t}]}, "outputDimensionality": self.dimensions} for t in texts]
        got = _post(f"{self.base}/{name}:batchEmbedContents", {"requests": requests}, {"x-goog-api-key": self.key})
        out = np.array([e["values"] for e in got["embeddings"]], np.float32)
        if out.shape != (len(texts), self.dimensions):
            raise ValueError(f"embeddings of shape {out.shape}, expected {(len(texts), self.dimensions)}")
        return out


class GeminiCompleter:
    """CON-2: an empty response is an error."""

    def __init__(self, model: str, key: str, temperature: float = 0.0, base: str = "https://generativelanguage.googleapis.com/v1beta") -> None:
        self.model, self.key, self.temperature, self.base = model, key, temperature, base

    def complete(self, system: str, user: str) -> str:
        body = {"system_instruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": user}]}], "generationConfig": {"temperature": self.temperature}}
        got = _post(f"{self.base}/models/{self.model}:generateContent", body, {"x-goog-api-key": self.key})
        text = "".join(p.get("text", "") for c in got.get("candidates", [])[:1] for p in c.get("content", {}).get("parts", []))
        if not text.strip():
            raise ValueError("the model returned no text")
        return text


class ChatCompleter:
    """CON-3: chat completions of an OpenAI-compatible server."""

    def __init__(self, model: str, base_url: str, key: str | None = None, temperature: float = 0.0) -> None:
        self.model, self.base_url, self.key, self.temperature = model, base_url.rstrip("/"), key, temperature

    def complete(self, system: str, user: str) -> str:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        got = _post(f"{self.base_url}/chat/completions", body, {"Authorization": f"Bearer {self.key}"} if self.key else {})
        text = got["choices"][0]["message"]["content"] or ""
        if not text.strip():
            raise ValueError("the model returned no text")
        return text


def embedder_for(provider: str, **options) -> Callable[[], Embedder]:
    """EM-4: a factory that a partition calls."""
    kinds = {"offline": HashingEmbedder, "gemini": GeminiEmbedder}
    if provider not in kinds:
        raise ValueError(f"unknown embedding provider {provider!r}")
    return lambda: kinds[provider](**options)


def completer_for(provider: str, **options) -> Callable[[], Completer]:
    """GN-4."""
    kinds = {"offline": ExtractiveCompleter, "gemini": GeminiCompleter, "openai_compat": ChatCompleter}
    if provider not in kinds:
        raise ValueError(f"unknown generation provider {provider!r}")
    return lambda: kinds[provider](**options)


def normalised(matrix: np.ndarray) -> np.ndarray:
    """SC-16 on a matrix."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def keyed(rows: DataFrame, text_col: str, model: str, dims: int, template: str) -> DataFrame:
    """Rows with the text that is embedded and its cache key."""
    filled = T.filled(template, F.col(text_col))
    return rows.withColumn("embedded_text", filled).withColumn("cache_key", T.digest(F.lit(model), F.lit(str(dims)), filled))


#: Misses that a model gets before its answers are saved.
ROUND = 20_000


def answered(wanted: DataFrame, run: Callable, schema: str, cache: Any, partitions: int, per_round: int = ROUND) -> tuple[DataFrame, DataFrame | None]:
    """(everything known, the new entries): the misses among ``wanted`` go to the model once.

    ``cache`` is a table, nothing, or something with ``read`` and ``append`` (``files.Cache``).  The
    last gets the answers round by round, so a failed run keeps all but its last round, and
    nothing is new afterwards.  Otherwise the new entries are persisted: whoever reads them
    twice does not ask the model twice.
    """
    saves = hasattr(cache, "append")
    held = cache.read() if saves else cache
    if held is not None:
        wanted = wanted.join(held.select("cache_key"), "cache_key", "left_anti")
    if not saves:
        fresh = wanted.repartition(partitions).mapInArrow(run, schema).persist()
        return (fresh if held is None else held.select(*fresh.columns).unionByName(fresh)), fresh
    rounds = -(-wanted.count() // per_round)
    for k in range(rounds):
        part = wanted.where(F.pmod(F.xxhash64("cache_key"), F.lit(rounds)) == k)
        cache.append(part.repartition(partitions).mapInArrow(run, schema))
    known = cache.read()
    return (wanted.repartition(1).mapInArrow(run, schema) if known is None else known), None


def embed(rows: DataFrame, text_col: str, make: Callable[[], Embedder], model: str, dims: int, template: str = "{text}", cache: Any = None, batch_size: int = 100, requests_per_minute: int | None = None, tokens_per_minute: int | None = None, partitions: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """EM-1, EM-2: (rows with ``vector``, the new cache entries; none if the cache saves them itself).

    Every distinct text is embedded once; quotas are divided by the partitions that call.
    """
    rows = keyed(rows, text_col, model, dims, template)
    wanted = rows.select("cache_key", "embedded_text").dropDuplicates(["cache_key"])

    def run(batches: Iterable[pa.RecordBatch]):
        client = make()
        limiter = RateLimiter(max(1, requests_per_minute // partitions), tokens_per_minute and max(1, tokens_per_minute // partitions)) if requests_per_minute else None
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                texts = part.column("embedded_text").to_pylist()

                def ask(texts=texts):  # every try counts against the limit
                    if limiter:
                        limiter.acquire(sum(-(-len(t) // 4) for t in texts))
                    return client.embed(texts)

                matrix = normalised(np.asarray(with_retries(ask, transient), np.float32))
                if matrix.shape != (len(texts), dims):
                    raise ValueError(f"embeddings of shape {matrix.shape}, expected {(len(texts), dims)}")
                yield pa.RecordBatch.from_arrays([part.column("cache_key"), pa.array(matrix.tolist(), pa.list_(pa.float32()))], names=["cache_key", "vector"])

    known, fresh = answered(wanted, run, "cache_key string, vector array<float>", cache, partitions)
    return rows.join(known, "cache_key").drop("embedded_text"), fresh


def context_text(chunks: DataFrame, by: list[str]) -> DataFrame:
    """GN-1: numbered sources in rank order, without ids."""
    stripped = T.unicode_trim(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", stripped.alias("text"))))
    block = F.array_join(F.transform(ordered, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), x["text"])), "\n\n")
    return chunks.groupBy(*by).agg(block.alias("context"))


def prompts(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """GN-2: the user prompt of each question."""
    out = contexts.join(questions.select("question_id", "question"), "question_id")
    return out.withColumn("user", F.concat("context", F.lit("\n\nQuestion: "), "question"))


def generate(rows: DataFrame, make: Callable[[], Completer], provider: str, model: str, temperature: float, cache: Any = None, system: str = SYSTEM_PROMPT, requests_per_minute: int | None = None, partitions: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """GN-3, GN-5: (rows with answer and latency_s, the new cache entries as for ``embed``); a hit keeps its first latency."""
    rows = rows.withColumn("cache_key", T.digest(F.lit(provider), F.lit(model), F.lit(str(temperature)), F.lit(system), F.col("user")))
    wanted = rows.select("cache_key", "user").dropDuplicates(["cache_key"])

    def run(batches: Iterable[pa.RecordBatch]):
        client = make()
        limiter = RateLimiter(max(1, requests_per_minute // partitions)) if requests_per_minute else None
        for batch in batches:
            for key, user in zip(batch.column("cache_key").to_pylist(), batch.column("user").to_pylist(), strict=True):

                def ask(user=user):
                    if limiter:
                        limiter.acquire()
                    began = time.monotonic()
                    return client.complete(system, user).strip(), round(time.monotonic() - began, 2)

                answer, seconds = with_retries(ask, transient)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([answer]), pa.array([seconds])], names=["cache_key", "answer", "latency_s"])

    known, fresh = answered(wanted, run, "cache_key string, answer string, latency_s double", cache, partitions)
    return rows.join(known, "cache_key"), fresh


def cache_use(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """AGG-16: hits and misses among the distinct keys."""
    keys = rows.select("cache_key").distinct().join(cache.select("cache_key", F.lit(True).alias("hit")), "cache_key", "left")
    return keys.agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


def request_window(requests: DataFrame, ts: str = "ts", tokens: str = "tokens", by: list[str] | None = None, seconds: int = 60, stretch: int = 3600) -> DataFrame:
    """WIN-10: requests and tokens in the ``seconds`` before and with each request (the edge excluded).

    Time is cut into stretches, each with a copy of the last ``seconds`` before it, so that one
    long log is many tasks.
    """
    from pyspark.sql import Window

    by = by or []
    width, reach = stretch * 1_000_000, seconds * 1_000_000 - 1
    rows = requests.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    own = F.floor(F.col("__us") / width).cast("long")
    late = F.col("__us") + reach >= (own + 1) * width
    rows = rows.withColumn("__own", own).withColumn("__at", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = Window.partitionBy(*by, "__at").orderBy("__us").rangeBetween(-reach, 0)
    out = rows.withColumn("requests_60s", F.count(F.lit(1)).over(frame)).withColumn("tokens_60s", F.sum(tokens).over(frame))
    return out.where("__at = __own").drop("__us", "__own", "__at")
