"""Model-written one-line descriptions with backend fallback.

Everything that can run in the JVM does: the 8000-byte cut, the prompt and
the JSON request body are built with Spark functions, and the cache lookup is
an anti-join, so only cache misses reach Python.  The network calls happen in
``mapInPandas`` on executors, one batch of rows at a time; each row tries the
backends in order and the first usable completion wins.  ``max_concurrency``
caps how many tasks talk to the backends at once (a repartition).

A backend is ``Backend(name, model, send, options)`` where ``send(body_json)``
returns ``(http_status, response_text)``; ``http_backend`` builds one that
POSTs to an OpenAI-compatible endpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.filters import too_large, too_large_message
from codeloom.operators.summary import empty_functions, empty_symbols, with_text

# ---------------------------------------------------------------------------
# Fixed values of the request and the error texts.
# ---------------------------------------------------------------------------
MAX_TOKENS = 150
TEMPERATURE = 0.2
DEFAULT_TIMEOUT_S = 30
NO_BACKENDS = "No LLM backends configured. Please add at least one backend in config.toml"
ALL_FAILED = "all backends failed"
# ---------------------------------------------------------------------------

Sender = Callable[[str], tuple[int, str]]


@dataclass
class Backend:
    name: str
    model: str
    send: Sender
    options: dict | None = field(default=None)


def http_backend(name: str, api_url: str, model: str, api_key: str | None = None,
                 timeout_s: int = DEFAULT_TIMEOUT_S, options: dict | None = None) -> Backend:
    """An OpenAI-compatible chat-completions endpoint."""

    def send(body: str) -> tuple[int, str]:
        import urllib.error
        import urllib.request
        req = urllib.request.Request(api_url, data=body.encode("utf-8"), method="POST",
                                     headers={"Content-Type": "application/json"})
        if api_key:
            req.add_header("Authorization", f"Bearer {api_key}")
        try:
            with urllib.request.urlopen(req, timeout=timeout_s) as resp:
                return resp.status, resp.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, ""
        except Exception as e:  # network errors count as a failed backend
            return 0, str(e)

    return Backend(name, model, send, options)


def request_body(prompt, model: str, options: dict | None = None):
    """JSON body; keys in sorted order as the reference's JSON map prints them."""
    fields = [F.lit(MAX_TOKENS).alias("max_tokens"),
              F.array(F.struct(prompt.alias("content"), F.lit("user").alias("role"))).alias("messages"),
              F.lit(model).alias("model")]
    if options:
        fields.append(F.from_json(F.lit(json.dumps(options, sort_keys=True)),
                                  F.schema_of_json(F.lit(json.dumps(options, sort_keys=True)))).alias("options"))
    fields.append(F.lit(TEMPERATURE).alias("temperature"))
    return F.to_json(F.struct(*fields))


def _completion(text: str) -> str | None:
    """``choices[0].message.content`` if it is a string (trimmed), else None."""
    try:
        v = json.loads(text)
        c = v["choices"][0]["message"]["content"]
    except Exception:
        return None
    return c.strip() if isinstance(c, str) else None


def _call_all(backends: list[Backend]):
    """Per batch: try each backend's prebuilt body in order; first usable completion wins."""
    def run(batches):
        for pdf in batches:
            texts, errors, used = [], [], []
            for i in range(len(pdf)):
                got = None
                pre = pdf["_err"].iat[i]
                if pre is not None:  # size guard / unreadable: no call, error passes through
                    used.append(None)
                    texts.append(T.ERROR_TEXT)
                    errors.append(pre)
                    continue
                for j, b in enumerate(backends):
                    status, resp = b.send(pdf[f"body_{j}"].iat[i])
                    if 200 <= status < 300:
                        got = _completion(resp)
                        if got is not None:
                            used.append(b.name)
                            break
                if got is None:
                    used.append(None)
                    texts.append(T.ERROR_TEXT)
                    errors.append(ALL_FAILED)
                else:
                    texts.append(got)
                    errors.append(None)
            yield pd.DataFrame({"path": pdf["path"], "relative": pdf["relative"], "text": texts,
                                "error": errors, "backend": used})
    return run


def describe_llm(files: DataFrame, backends: list[Backend], language: str = "ru",
                 max_file_size: int | None = None,
                 max_concurrency: int | None = None, prompt_cap: int | None = None) -> DataFrame:
    """(path, relative, text, error, backend) per file; prompts hold whole texts, or their first
    ``prompt_cap`` bytes.  Raises before any job when
    no backend is configured."""
    if not backends:
        raise ValueError(NO_BACKENDS)
    base = with_text(files)
    err = (F.when(too_large("size", max_file_size), too_large_message("size", max_file_size or 0))
           .when(F.col("_text").isNull(), F.lit("cannot read: stream did not contain valid UTF-8")))
    # one pass: rows with an error carry it through the same mapInPandas (no call, no second scan)
    prompt = T.build_prompt("relative", "_text", language, prompt_cap)
    todo = base.select(
        "path", "relative", err.alias("_err"),
        *[F.when(err.isNull(), request_body(prompt, b.model, b.options)).alias(f"body_{j}")
          for j, b in enumerate(backends)])
    if max_concurrency:
        todo = todo.repartition(max_concurrency)
    return todo.mapInPandas(_call_all(backends),
                            "path string, relative string, text string, error string, backend string")


def llm_descriptions(described: DataFrame) -> DataFrame:
    """Description-shaped rows (for trees and caches) from describe_llm or incremental_describe output."""
    cached = F.col("from_cache") if "from_cache" in described.columns else F.lit(False).alias("from_cache")
    return described.select("path", "relative", F.lit(None).cast("bigint").alias("total_lines"),
                            empty_symbols().alias("symbols"), empty_functions().alias("functions"),
                            "text", "error", cached)
