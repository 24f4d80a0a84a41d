"""Hooks for models that live outside the engine; everything is deterministic with the hooks that tests give."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

ROLES = ("system", "user", "assistant", "tool", "developer")
MOST_ATTEMPTS = 8


def in_order(given: list) -> list[list[float]]:
    """Vectors as an embedder returns them: plain, or as objects whose ``index`` tells their place."""
    if given and all(isinstance(g, dict) for g in given):
        given = [g["embedding"] for g in sorted(given, key=lambda g: g.get("index", 0))]
    return given


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """Vectors of (id, text) in batches of ``batch`` texts; a batch with a wrong number of vectors fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list[list[float]] = []
            for k in range(0, len(pdf), batch):
                some = pdf["text"].iloc[k : k + batch].tolist()
                got = in_order(embedder(some))
                if len(got) != len(some):
                    raise ValueError("the embedder returned a wrong number of vectors")
                vectors += got
            yield pd.DataFrame({"id": pdf["id"], "vector": vectors})

    return rows.select("id", "text").mapInPandas(run, "id string, vector array<double>")


def extract(chapters: DataFrame, extractor: Callable[[dict], dict], on_start: Callable[[dict], None] | None = None, on_complete: Callable[[dict, dict], None] | None = None) -> DataFrame:
    """One JSON payload of nodes and relationships per chapter; the callbacks hear of each chapter before and after."""

    def one(row: dict) -> str:
        if on_start:
            on_start(row)
        payload = extractor(row)
        if on_complete:
            on_complete(row, payload)
        return json.dumps(payload, ensure_ascii=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"chapter_id": pdf["chapter_id"], "payload": [one(r) for r in pdf.to_dict("records")]})

    return chapters.mapInPandas(run, "chapter_id string, payload string")


EXTRACTION_RULE = "List the knowledge points of this chapter and how they relate. Answer with one JSON object that has nodes (name, definition, category, page, source_quote) and relationships (source, target, relation_type, description, evidence)."
ANSWER_RULE = "Answer from the passages alone and cite them as they are written in brackets. Where they do not hold the answer, say that nothing was found."


def extraction_prompts(chapters: DataFrame, limit: int = 9000) -> DataFrame:
    """What an extractor is asked for each chapter (book, chapter_id, title, page_start, content): system text and user text."""
    head = F.format_string("Book: %s\nChapter: %s\nFirst page: %s\n\n", F.col("book"), F.col("title"), F.col("page_start").cast("string"))
    return chapters.select("chapter_id", F.lit(EXTRACTION_RULE).alias("system"), F.concat(head, T.trim_to_length(F.col("content"), limit)).alias("user"))


def answer_prompts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """What a model is asked for each question (query_id, query): the passages found (query_id, rank, source_ref, text), in order."""
    passage = F.concat("source_ref", F.lit("\n"), "text")
    listed = F.array_sort(F.collect_list(F.struct("rank", passage.alias("said"))))
    context = found.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda p: p["said"]), "\n\n").alias("context"))
    user = F.concat(F.lit("Question: "), "query", F.lit("\n\n"), F.coalesce("context", F.lit("")))
    return questions.join(context, "query_id", "left").select("query_id", F.lit(ANSWER_RULE).alias("system"), user.alias("user"))


def answer(questions: DataFrame, generator: Callable[[str, list[str]], str]) -> DataFrame:
    """Answers to (query_id, query, chunks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf["query_id"], "answer": [generator(q, list(c)) for q, c in zip(pdf["query"], pdf["chunks"], strict=True)]})

    return questions.select("query_id", "query", "chunks").mapInPandas(run, "query_id string, answer string")


def first_json_object(text: str) -> dict | None:
    """The object in a model's reply: in a fenced block, else the first balanced braces outside strings."""
    fence = text.find("```")
    if fence >= 0 and (end := text.find("```", fence + 3)) > 0:
        inside = text[fence + 3 : end]
        text = inside[inside.find("\n") + 1 :] if not inside.lstrip().startswith("{") else inside
    start = text.find("{")
    while start >= 0:
        try:
            found, _ = json.JSONDecoder().raw_decode(text, start)
            return found if isinstance(found, dict) else None
        except ValueError:
            start = text.find("{", start + 1)
    return None


def messages(given: str | dict) -> list[dict]:
    """Chat messages from a string, from messages, or from a prompt with or without a system prompt."""
    if isinstance(given, str):
        given = {"prompt": given}
    if given.get("messages"):
        out = [{"role": m.get("role", "user"), "content": m.get("content", "")} for m in given["messages"]]
        if bad := [m["role"] for m in out if m["role"] not in ROLES]:
            raise TypeError(f"unknown role {bad[0]}")
        return out
    if not str(given.get("prompt") or "").strip():
        raise TypeError("prompt or messages are required")
    system = [{"role": "system", "content": given["systemPrompt"]}] if given.get("systemPrompt") else []
    return [*system, {"role": "user", "content": given["prompt"]}]


def bounded(value: float | None, low: float, high: float, name: str) -> float | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int | float) or not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


class Client:
    """A chat model behind ``send(request) -> text``. Options that a provider refuses are left out one by one."""

    def __init__(self, endpoint: str, api_key: str, model: str, send: Callable[[dict], str]) -> None:
        if not endpoint or not model:
            raise TypeError("endpoint and model are required")
        self.endpoint, self.model, self.send, self._key = endpoint.rstrip("/"), model, send, api_key

    def described(self) -> dict:
        """What may be shown of the client: all but its key."""
        return {"endpoint": self.endpoint, "defaultModel": self.model, "hasApiKey": bool(self._key)}

    def variants(self, given: str | dict, temperature: float | None = None, max_tokens: int | None = None) -> list[dict]:
        base = {"model": self.model, "messages": messages(given)}
        heat = {"temperature": t} if (t := bounded(temperature, 0, 2, "temperature")) is not None else {}
        size = bounded(max_tokens, 1, 128_000, "maxTokens")
        sizes = [{"max_tokens": size}, {"max_completion_tokens": size}, {}] if size is not None else [{}]
        out: list[dict] = []
        for extra in [{**heat, **s} for s in sizes] + sizes:
            if (one := base | extra) not in out:
                out.append(one)
        return out[:MOST_ATTEMPTS]

    def complete(self, given: str | dict, **options) -> str:
        last: Exception | None = None
        for request in self.variants(given, **options):
            try:
                return self.send(request)
            except ValueError as e:  # the provider refused a parameter
                last = e
        raise last or RuntimeError("no request was sent")
