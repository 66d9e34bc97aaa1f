"""The reviewer: prompts, the pluggable call, its retries, and the deterministic stub that stands in for a model."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PARSED_EXTENSIONS

EXTRACT_BASE = "List every call and import of the code below as caller<SEP>callee<SEP>summary<SEP>first-last, one per line."
AUDIT_BASE = "Review the call chains below and report only weaknesses that the code itself shows, in the given layout."
LANGUAGE_RULES = {e: f"Rules for {e[1:]}: name members by their owner, keep the line numbers of the listing." for e in PARSED_EXTENSIONS}


def extraction_prompt(ext: Column) -> Column:
    rules = F.create_map(*[F.lit(x) for kv in LANGUAGE_RULES.items() for x in kv])
    return F.concat_ws("\n", F.lit(EXTRACT_BASE), rules[F.lower(ext)])


def languages_in(payload: Column) -> Column:
    """Extensions of parsed languages that are found anywhere in a text, distinct and sorted."""
    found = F.regexp_extract_all(F.lower(payload), F.lit(r"\.(?:py|js|ts|java|go|php|cpp|cs|c)\b"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def audit_prompt(exts: Column) -> Column:
    rules = F.create_map(*[F.lit(x) for kv in LANGUAGE_RULES.items() for x in kv])
    return F.concat_ws("\n", F.lit(AUDIT_BASE), F.array_join(F.array_distinct(F.filter(F.transform(exts, lambda e: rules[e]), lambda r: r.isNotNull())), "\n"))


def stub(payload: str) -> str:
    """A fixed answer by the payload's hash: a pass for most, a finding for some; no model and no network."""
    h = int(hashlib.sha256(payload.encode()).hexdigest()[:8], 16)
    if h % 4:
        return "<审计报告>\n<结论>审计通过</结论>\n</审计报告>"
    return f"<审计报告>\n<文件>\n路径: context\n结论: 发现漏洞\n<漏洞>\n类型: stub_{h % 7}\n判定: 可疑\n等级: {('高危', '中危', '低危')[h % 3]}\n位置: L1-L2\n<代码特征>\nstub\n</代码特征>\n</漏洞>\n</文件>\n</审计报告>"


def reviewed(payloads: DataFrame, key: str, call: Callable[[str], str] = stub, attempts: int = 3, backoff: float = 0.0, concurrency: int = 5, limit_tokens: int | None = None) -> DataFrame:
    """(key, ok, response, error): call for every payload, retried with linear backoff; a failure is a row, not an exception.

    The number of tasks bounds the number of calls at once; a task that is run again calls again, so call must be repeatable.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k, p in zip(pdf[key], pdf.payload):
                if limit_tokens is not None and -(-len(p or "") // 4) > limit_tokens:
                    out.append((k, False, None, "above the input limit"))
                    continue
                error = None
                for n in range(1, max(1, attempts) + 1):
                    try:
                        out.append((k, True, call(p or ""), None))
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of the reviewer is its row's error
                        error = str(e)[:500]
                        if n < attempts:
                            time.sleep(backoff * n)
                else:
                    out.append((k, False, None, error))
            yield pd.DataFrame(out, columns=[key, "ok", "response", "error"])

    kind = payloads.schema[key].dataType.simpleString()
    return payloads.select(key, "payload").repartition(concurrency).mapInPandas(run, f"`{key}` {kind}, ok boolean, response string, error string")
