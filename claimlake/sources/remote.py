"""Opt-in probes of web links, and the kept line times of version control."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.operators.extract import LOCAL_HOSTS


def http_status(url: str, timeout: float = 10) -> int:
    """HEAD, then GET where HEAD is refused; 0 for no answer."""
    import urllib.error
    import urllib.request

    for method in ("HEAD", "GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, method=method), timeout=timeout) as answer:  # noqa: S310
                return answer.status
        except urllib.error.HTTPError as refused:
            if method == "GET" or refused.code not in (403, 405, 501):
                return refused.code
        except (OSError, ValueError):
            return 0
    return 0


def probe(urls: DataFrame, status: Callable[[str], int] = http_status, threads: int = 8) -> DataFrame:
    """(url, status) of every distinct public address; each is asked once, a few at a time per task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                yield pd.DataFrame({"url": batch["url"], "status": list(pool.map(status, batch["url"]))})

    public = urls.select("url").where("url is not null").distinct().where(~F.col("url").rlike(LOCAL_HOSTS))
    return public.mapInPandas(run, "url string, status int")


def broken(probed: DataFrame) -> DataFrame:
    return probed.where("status = 0 or status >= 400")


def missing_blobs(wanted: DataFrame, kept: DataFrame) -> DataFrame:
    """(file, blob) whose line times are not kept yet; the rest is read from the table instead of asked again."""
    return wanted.select("file", "blob").where("blob is not null").join(kept.select("blob").distinct(), "blob", "left_anti")


def keep_used(kept: DataFrame, wanted: DataFrame) -> DataFrame:
    """The kept line times that this run used; the others are dropped when the table is written again."""
    return kept.join(wanted.select("blob").distinct(), "blob", "left_semi")
