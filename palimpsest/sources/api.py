"""The preprint service: a batch data source of its pages, look-ups by identifier, downloads, and retries."""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The service's addresses, page size and fields, and the statuses worth another try.
DETAILS = "https://api.medrxiv.org/details"
CONTENT = "https://www.medrxiv.org/content"
PAGE = 100
META = ["doi", "version", "date", "title", "authors", "author_corresponding", "author_corresponding_institution", "type", "license", "category", "jatsxml", "abstract", "published", "server"]
RETRIED = (429, 500, 502, 503, 504)
COLLECTION = "struct<collection:array<struct<" + ",".join(f"{k}:string" for k in META) + ">>>"

#: A fetcher takes an address and gives (status, headers, body).
Fetcher = Callable[[str], tuple[int, dict, bytes]]


@dataclass(frozen=True)
class Retry:
    """How often and how long to wait. The waits are base * 2**attempt up to the cap, times or plus jitter."""

    attempts: int = 8
    base: float = 1.0
    cap: float = 90.0
    header_capped: bool = True
    any_server_error: bool = False
    jitter: str = "factor"
    retry_connection: bool = True


SCAN, ENRICH = Retry(), Retry(cap=60.0, header_capped=False, any_server_error=True, jitter="plus", retry_connection=False)


def client(timeout: float = 60, user_agent: str = "") -> Fetcher:
    """A fetcher over HTTP."""

    def http(url: str) -> tuple[int, dict, bytes]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers={"User-Agent": user_agent} if user_agent else {}), timeout=timeout) as r:
                return r.status, dict(r.headers), r.read()
        except HTTPError as e:
            return e.code, dict(e.headers or {}), b""

    return http


http = client()


def shared_pause(rows: DataFrame, pause: float) -> float:
    """The pause of each task, so that all that run at once keep the pace of one with `pause`."""
    return pause * min(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)


def fetch(url: str, fetcher: Fetcher = http, retry: Retry = SCAN, sleep: Callable[[float], None] = time.sleep, rng: Callable[[], float] = random.random) -> tuple[int, bytes]:
    """Status and body after retries; the last failure is raised."""
    for attempt in range(retry.attempts):
        wait = min(retry.cap, retry.base * 2**attempt)
        try:
            status, headers, body = fetcher(url)
        except OSError:
            if not retry.retry_connection or attempt + 1 == retry.attempts:
                raise
        else:
            if not (status in RETRIED or retry.any_server_error and status >= 500):
                return status, body
            told = str(headers.get("Retry-After", ""))
            if told.isdigit():
                wait = min(retry.cap, int(told)) if retry.header_capped else int(told)
        sleep(wait * (0.75 + rng() / 2) if retry.jitter == "factor" else wait + rng() / 4)
    raise OSError(f"gave up on {url} after {retry.attempts} attempts")


def checked_date(text: str) -> str:
    datetime.strptime(text, "%Y-%m-%d")
    return text


def pdf_url(doi: Column, version: Column) -> Column:
    return F.concat(F.lit(f"{CONTENT}/"), doi, F.lit("v"), version.cast("string"), F.lit(".full.pdf"))


def cache_name(doi: Column, version: Column) -> Column:
    return F.concat(F.replace(doi, F.lit("/"), F.lit("_")), F.lit("v"), version.cast("string"), F.lit(".pdf"))


def paper_key(doi: Column, version: Column) -> Column:
    return F.concat(doi, F.lit("v"), version.cast("string"))


def doi_path(doi: Column) -> Column:
    """A DOI quoted for an address, slashes kept."""
    return F.replace(F.replace(F.url_encode(doi), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))


class PreprintSource(DataSource):
    """format("preprints"): (doi, version, date) of a date range. Options: start, end, max_papers, base (address or folder).

    A folder holds the pages as files start_end_cursor.json, for tests and offline use. Days are read in parallel,
    a page after the other within each; a page that can't be parsed is tried again a bounded number of times.
    """

    @classmethod
    def name(cls) -> str:
        return "preprints"

    def schema(self) -> str:
        return "doi string, version int, date string"

    def reader(self, schema) -> DataSourceReader:
        return PreprintReader(self.options)


class Day(InputPartition):
    def __init__(self, start: str, end: str):
        super().__init__((start, end))


class PreprintReader(DataSourceReader):
    def __init__(self, options):
        self.start, self.end = checked_date(options["start"]), checked_date(options["end"])
        self.base, self.most = options.get("base", f"{DETAILS}/medrxiv"), int(options.get("max_papers", 0))

    def partitions(self) -> list[InputPartition]:
        if self.most:
            return [Day(self.start, self.end)]
        days = pd.date_range(self.start, self.end).strftime("%Y-%m-%d")
        return [Day(d, d) for d in days] if "://" in self.base else [Day(self.start, self.end)]

    def read(self, partition: Day) -> Iterator[tuple]:
        start, end = partition.value
        cursor = sent = tries = 0
        while True:
            try:
                rows = json.loads(self._page(start, end, cursor)).get("collection") or []
            except ValueError:
                tries += 1
                if tries > 8:
                    raise
                time.sleep(2)
                continue
            for r in rows:
                if r.get("doi") and r.get("version") is not None and r.get("date"):
                    yield r["doi"], int(r["version"]), r["date"]
                    sent += 1
                    if self.most and sent >= self.most:
                        return
            if len(rows) < PAGE:
                return
            cursor += PAGE

    def _page(self, start: str, end: str, cursor: int) -> bytes:
        if "://" in self.base:
            return fetch(f"{self.base}/{start}/{end}/{cursor}/json")[1]
        path = os.path.join(self.base, f"{start}_{end}_{cursor}.json")
        if not os.path.exists(path):
            return b"{}"
        with open(path, "rb") as f:
            return f.read()


def flatten_collection(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Response bodies to one row for each entry, all fields as strings, missing ones ''."""
    entries = F.coalesce(F.from_json(body, COLLECTION)["collection"], F.array().cast(COLLECTION[18:-1]))
    rows = bodies.select(*[c for c in bodies.columns if c != body and c not in META], F.explode(entries).alias("e"))
    return rows.select(*[c for c in rows.columns if c != "e"], *(F.coalesce(f"e.{k}", F.lit("")).alias(k) for k in META))


def enrich(dois: DataFrame, server: str = "medrxiv", fetcher: Fetcher = http, retry: Retry = ENRICH, pause: float = 0.2) -> DataFrame:
    """Metadata of each DOI: a row for each version; one blank row where the look-up fails; none where it is empty."""
    schema = ", ".join(f"{k} string" for k in META)
    pause = shared_pause(dois, pause)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doi in batch["doi"]:
                blank = dict.fromkeys(META, "") | {"doi": doi, "server": server}
                try:
                    status, body = fetch(f"{DETAILS}/{server}/{quote(doi, safe='/')}", fetcher, retry)
                    if status >= 400:
                        raise OSError(f"status {status}")
                    answer = json.loads(body)
                    if not isinstance(answer, dict):
                        raise ValueError("not an object")
                    for e in answer.get("collection") or []:
                        rows.append({k: str(e[k]) if e.get(k) is not None else blank[k] for k in META})
                except (OSError, ValueError):
                    rows.append(blank)
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=META)

    return dois.select("doi").mapInPandas(run, schema)


def download(preprints: DataFrame, folder: str, fetcher: Fetcher = http, pause: float = 0.25, retry: Retry = SCAN, content: bool = False) -> DataFrame:
    """(doi, version, date) with pdf_downloaded and pdf_path: from the cache folder if there and not empty, else fetched.

    content: the files' bytes as well, read where they were fetched, so that the folder need not be a shared one.
    """
    named = preprints.withColumns({"__url": pdf_url(F.col("doi"), F.col("version")), "__name": cache_name(F.col("doi"), F.col("version"))})
    pause = shared_pause(named, pause)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doi, version, date, url, name in batch[["doi", "version", "date", "__url", "__name"]].itertuples(index=False):
                path = os.path.join(folder, name)
                if not (os.path.exists(path) and os.path.getsize(path)):
                    path = _save(url, path, fetcher, retry)
                    time.sleep(pause)
                row = {"doi": [doi], "version": [version], "date": [date], "pdf_downloaded": [path is not None], "pdf_path": [path]}
                if content:
                    row |= {"file_size_bytes": [os.path.getsize(path) if path else 0], "mtime": [pd.Timestamp(os.path.getmtime(path), unit="s").floor("us") if path else None]}
                    with open(path or os.devnull, "rb") as f:
                        row["content"] = [f.read() if path else None]
                yield pd.DataFrame(row)

    return named.mapInPandas(run, "doi string, version int, date string, pdf_downloaded boolean, pdf_path string" + (", file_size_bytes bigint, mtime timestamp, content binary" if content else ""))


def _save(url: str, path: str, fetcher: Fetcher, retry: Retry = SCAN) -> str | None:
    try:
        status, body = fetch(url, fetcher, retry)
    except OSError:
        return None
    if status != 200 or not body:
        return None
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(body)
    os.replace(part, path)
    return path


