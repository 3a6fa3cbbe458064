"""Models behind HTTP: embeddings, relevance, replies. Each fails open: what can't be reached has a defined stand-in."""

from __future__ import annotations

import json
import logging
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
#: Seconds that a call may take, and a ping.
TIMEOUT, PING = 60.0, 2.0


def post(url: str, body: dict, timeout: float = TIMEOUT) -> dict:
    """The JSON reply of a service to a JSON request."""
    asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(asked, timeout=timeout) as reply:
        return json.load(reply)


def reachable(url: str, timeout: float = PING) -> bool:
    """Whether a service answers at all: what the driver asks before it plans to use it."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as reply:
            return reply.status < 500
    except OSError:
        return False


def embedder(url: str, model: str) -> Callable[[list[str]], list[list[float]]]:
    """For store.embed(): vectors of a list of texts. It raises where the service fails, and store.embed() falls back."""
    return lambda texts: post(f"{url}/embed", {"model": model, "input": texts})["embeddings"]


def relevance(url: str, model: str) -> Callable[[Column, Column], Column]:
    """For retrieval.rerank(): a passage's relevance to a query; null where the service fails, so that a query keeps its order."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, passages in parts:
            found = pd.Series([None] * len(queries), index=queries.index, dtype="float64")
            for query, rows in passages.groupby(queries, sort=False):
                try:
                    results = post(f"{url}/rerank", {"model": model, "query": query, "documents": rows.tolist()})["results"]
                    scores = {int(r["index"]): float(r["relevance_score"]) for r in results}
                    if sorted(scores) != list(range(len(rows))):
                        raise ValueError("another number of scores than of passages")
                    found[rows.index] = [scores[k] for k in range(len(rows))]
                except (OSError, ValueError, KeyError, TypeError) as e:
                    LOG.warning("not ranked anew: %s", e)
            yield found

    return score


def replies(url: str, model: str, timeout: float = TIMEOUT) -> Callable[[Column], Column]:
    """For the gate, classification and answers: the reply to a prompt, an empty one where the service fails."""

    @F.pandas_udf("string")
    def reply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in parts:
            said = []
            for prompt in prompts:
                try:
                    said.append(str(post(f"{url}/generate", {"model": model, "prompt": prompt, "stream": False}, timeout)["response"]))
                except (OSError, ValueError, KeyError, TypeError) as e:
                    LOG.warning("no reply: %s", e)
                    said.append("")
            yield pd.Series(said)

    return reply
