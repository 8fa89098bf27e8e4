"""Boundaries to outside services, with stand-ins that need no network and always answer the same."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TextModel(Protocol):
    def chat(self, messages: list[dict]) -> str: ...


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Parser(Protocol):
    def parse(self, content: bytes, pages: str) -> str: ...


class Vision(Protocol):
    def describe(self, image: bytes, route: str) -> str: ...


class Busy(Exception):
    """The service asks to come later; ``after`` seconds, if it says."""

    def __init__(self, after: float | None = None) -> None:
        super().__init__("busy")
        self.after = after


def delay(attempt: int, base: float = 1.0, most: float = 30.0, jitter: float = 0.0, seed: int | None = None) -> float:
    return min(most, base * 2**attempt) + (random.Random(seed).uniform(0, jitter) if jitter else 0.0)


def tried[T](call: Callable[[], T], tries: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result, after up to ``tries`` attempts with growing pauses; what a busy service asks for goes first."""
    for k in range(tries):
        try:
            return call()
        except Exception as e:
            if k == tries - 1:
                raise
            sleep(e.after if isinstance(e, Busy) and e.after is not None else delay(k, base))
    raise AssertionError


def first_answer(models: list[TextModel], messages: list[dict]) -> str:
    """The answer of the first model of the chain (repeats left out) that is not busy."""
    last: Exception = Busy()
    for m in dict.fromkeys(models):
        try:
            return m.chat(messages)
        except Busy as e:
            last = e
    raise last


class HashEmbedder:
    """Stand-in: words' hashes as signs in a vector of unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


class EchoModel:
    """Stand-in: the last message, cited."""

    def chat(self, messages: list[dict]) -> str:
        return f"{messages[-1]['content'][:200]} [1]" if messages else ""


class TextParser:
    """Stand-in: the content as text, which is what plain text files need."""

    def parse(self, content: bytes, pages: str) -> str:
        return content.decode("utf-8", "replace")


#: What an image is said to show where no model answers, by its route.
FALLBACKS = {"data_visualization": "数据图表", "technical_diagram": "技术示意图", "formula_like": "公式图片", "form_like": "表格图片", "general_image": "图片"}


def embedded(rows: DataFrame, embedder: Embedder, text: str = "content", window: int = 8192, batch: int = 32) -> DataFrame:
    """Rows with ``embedding``, sent ``batch`` texts at a time; a text over the model's window has a null and ``too_long``."""
    from folioflow.functions.text import estimate_tokens

    marked = rows.withColumns({"too_long": estimate_tokens(text) > window, "embedding": F.lit(None).cast("array<double>")})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ok = [i for i in range(len(p)) if not p["too_long"].iloc[i] and p[text].iloc[i] is not None]
            vectors: list = [None] * len(p)
            for k in range(0, len(ok), batch):
                some = ok[k : k + batch]
                for i, v in zip(some, tried(lambda: embedder.embed([p[text].iloc[i] for i in some])), strict=True):  # noqa: B023
                    vectors[i] = v
            p["embedding"] = vectors
            yield p

    return marked.mapInPandas(run, marked.schema)


def parsed(files: DataFrame, parser: Parser, page_size: int = 180) -> DataFrame:
    """Files (path, content, page_count) parsed by page ranges: (path, markdown, parts, failed); parts are joined in order, and a failed one leaves a gap."""
    from folioflow.functions.text import page_ranges

    ranges = files.select("path", "content", F.posexplode(page_ranges(F.greatest("page_count", F.lit(1)), page_size)).alias("part", "pages"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content, part, pages in zip(p["path"], p["content"], p["part"], p["pages"], strict=True):
                try:
                    rows.append((path, part, tried(lambda: parser.parse(bytes(content), pages), base=0.0), None))  # noqa: B023
                except Exception as e:
                    rows.append((path, part, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "part", "markdown", "error"])

    done = ranges.mapInPandas(run, "path string, part int, markdown string, error string")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "markdown"))), lambda x: F.coalesce(x["markdown"], F.lit(""))), "\n\n")
    return done.groupBy("path").agg(text.alias("markdown"), F.count(F.lit(1)).alias("parts"), F.count("error").alias("failed"))


def described(images: DataFrame, vision: Vision | None = None) -> DataFrame:
    """Images (path, content, route) with description and status: ``ok``, or ``degraded`` with the route's stand-in text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content, route in zip(p["path"], p["content"], p["route"], strict=True):
                try:
                    if vision is None:
                        raise RuntimeError("no model")
                    rows.append((path, route, tried(lambda: vision.describe(bytes(content), route), base=0.0), "ok"))  # noqa: B023
                except Exception:
                    rows.append((path, route, FALLBACKS.get(route, FALLBACKS["general_image"]), "degraded"))
            yield pd.DataFrame(rows, columns=["path", "route", "description", "status"])

    return images.select("path", "content", "route").mapInPandas(run, "path string, route string, description string, status string")


class Tools:
    """Named functions that a model may call, for up to ``rounds`` rounds."""

    def __init__(self, rounds: int = 5) -> None:
        self.rounds, self.functions = rounds, {}

    def register(self, name: str, function: Callable[[dict], object]) -> None:
        self.functions[name] = function

    def run(self, ask: Callable[[list], dict | str]) -> tuple[object, list]:
        """``ask`` gets the results so far and answers with a call {name, args} or a final text; unknown tools and errors are results too."""
        results: list = []
        for _ in range(self.rounds):
            told = ask(results)
            if not isinstance(told, dict):
                return told, results
            try:
                results.append({"name": told["name"], "result": self.functions[told["name"]](told.get("args", {}))})
            except Exception as e:
                results.append({"name": told.get("name"), "error": str(e)})
        return None, results
