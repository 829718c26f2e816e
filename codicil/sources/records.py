"""Where data comes from: record files, archives, conditional downloads, page caches."""

from __future__ import annotations

import hashlib
import json
import os
import time
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the dataset.
COLUMNS = (
    "id_norma tipo_norma numero_norma clase_norma organismo_origen fecha_sancion numero_boletin fecha_boletin pagina_boletin titulo_resumido titulo_sumario "
    "texto_resumido observaciones texto_original texto_actualizado modificada_por modifica_a"
).split()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of records, all values strings, read in splits (see splits.py). A header that lacks a column is an error. ``line`` numbers the records in the
    order of their file (the first is 2); records without any value are left out and not counted."""
    from .splits import CSV, header, records

    names = header(spark, path)
    if missing := [c for c in COLUMNS if c not in names]:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")
    rows = records(spark, path).where("number > 1")
    return rows.select(F.from_csv("raw", ", ".join(f"`{n}` string" for n in names), CSV).alias("r"), F.col("number").alias("line")).select(*(F.coalesce(F.col(f"r.`{n}`"), F.lit("")).alias(n) for n in names), "line")


def extract_csv(archive: str, folder: str) -> str:
    """The first .csv of an archive, written under its own base name."""
    with zipfile.ZipFile(archive) as z:
        for entry in z.infolist():
            if entry.filename.lower().endswith(".csv"):
                to = os.path.join(folder, os.path.basename(entry.filename.replace("\\", "/")))
                os.makedirs(folder, exist_ok=True)
                with z.open(entry) as a, open(to, "wb") as b:
                    while block := a.read(1 << 20):
                        b.write(block)
                return to
    raise ValueError(f"no .csv in {archive}")


def resolve_csv(path: str, folder: str) -> str:
    return extract_csv(path, folder) if path.lower().endswith(".zip") else path


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes | Iterable[bytes] = b""
    headers: dict | None = None

    def blocks(self) -> Iterable[bytes]:
        """The body piece by piece: what is large need never be held as a whole."""
        return [self.body] if isinstance(self.body, bytes) else self.body

    def content(self) -> bytes:
        return self.body if isinstance(self.body, bytes) else b"".join(self.body)

    @property
    def ok(self) -> bool:
        return 200 <= self.status < 300


Get = Callable[[str, dict], Response]

#: Seconds without an answer after which a request is given up.
TIMEOUT = 20.0


def http_get(timeout: float = TIMEOUT, block: int = 1 << 20) -> Get:
    """Requests over HTTP; bodies are read in blocks. No answer in time is a network error."""

    def get(url: str, headers: dict) -> Response:
        import urllib.error
        import urllib.request

        try:
            answer = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout)
        except urllib.error.HTTPError as e:
            return Response(e.code, b"", dict(e.headers or {}))
        return Response(answer.status, iter(lambda: answer.read(block), b""), dict(answer.headers))

    return get


def save(answer: Response, to: str) -> str:
    """Writes a body beside its place, then moves it there; the SHA-256 of what was written."""
    digest = hashlib.sha256()
    with open(f"{to}.part", "wb") as f:
        for piece in answer.blocks():
            digest.update(piece)
            f.write(piece)
    return digest.hexdigest()


@dataclass(frozen=True)
class DatasetState:
    sha256: str
    downloaded_at: str
    etag: str | None = None
    last_modified: str | None = None


def sha256_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_state(path: str) -> DatasetState | None:
    """None where there is none, or what is there can't be read."""
    try:
        return DatasetState(**json.loads(Path(path).read_text()))
    except (OSError, ValueError, TypeError):
        return None


def write_json(path: str, value: object) -> None:
    """In one step: a reader sees the old file or the new one."""
    part = f"{path}.part"
    Path(part).write_text(json.dumps(value))
    os.replace(part, path)


def save_state(path: str, state: DatasetState) -> None:
    write_json(path, asdict(state))


def download(get: Get, url: str, to: str) -> str:
    answer = get(url, {})
    if not answer.ok:
        raise OSError(f"{url}: status {answer.status}")
    save(answer, to)
    os.replace(f"{to}.part", to)
    return to


def download_if_changed(get: Get, url: str, to: str, previous: DatasetState | None, now: str) -> tuple[str, DatasetState | None]:
    """("not_modified" | "same_content" | "changed", the new state): asks with the validators of last time, then compares contents."""
    ask = {}
    if previous and os.path.exists(to):
        ask = {k: v for k, v in (("If-None-Match", previous.etag), ("If-Modified-Since", previous.last_modified)) if v}
    answer = get(url, ask)
    if answer.status == 304:
        return "not_modified", previous
    if not answer.ok:
        raise OSError(f"{url}: status {answer.status}")
    heads = {k.lower(): v for k, v in (answer.headers or {}).items()}
    state = DatasetState(save(answer, to), now, heads.get("etag"), heads.get("last-modified"))
    if previous and previous.sha256 == state.sha256:
        os.remove(f"{to}.part")
        return "same_content", state
    os.replace(f"{to}.part", to)
    return "changed", state


@dataclass(frozen=True)
class Page:
    ok: bool
    reason: str | None = None
    status: int | None = None
    body: bytes | None = None
    content_type: str | None = None


def polite_fetcher(get: Get, delay: float = 1.0, retries: int = 2, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Callable[[str], Page]:
    """One request at a time, ``delay`` seconds apart at least; network errors, 429 and 5xx are tried again, each time twice as late."""
    last = [float("-inf")]

    def once(url: str) -> Page:
        if (rest := last[0] + delay - clock()) > 0:
            sleep(rest)
        last[0] = clock()
        try:
            a = get(url, {})
        except OSError as e:
            return Page(False, f"network error: {e}")
        if a.ok:
            heads = {k.lower(): v for k, v in (a.headers or {}).items()}
            return Page(True, status=a.status, body=a.content(), content_type=heads.get("content-type"))
        return Page(False, f"HTTP {a.status}", a.status)

    def fetch(url: str) -> Page:
        for attempt in range(retries + 1):
            page = once(url)
            if page.ok or page.status is not None and page.status != 429 and page.status < 500 or attempt == retries:
                return page
            sleep(delay * 2**attempt)
        raise AssertionError

    return fetch


def fetch_pages(wanted: DataFrame, fetcher: Callable[[], Callable[[str], Page]], most_forbidden: int = 5) -> DataFrame:
    """id, source, url, ok, reason, status, body, content_type of each row (id, source, url), by one task, in the order of ids: the site
    is asked politely. After most_forbidden refusals (403) in a row the rest is marked "aborted" and not asked for."""
    schema = "id long, source string, url string, ok boolean, reason string, status int, body binary, content_type string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch, refused = fetcher(), 0
        for b in batches:
            rows = []
            for r in b.to_pylist():
                page = Page(False, "aborted") if refused >= most_forbidden else fetch(r["url"])
                if page.reason != "aborted":
                    refused = refused + 1 if page.status == 403 else 0 if page.ok or page.status is not None else refused
                rows.append(r | {"ok": page.ok, "reason": page.reason, "status": page.status, "body": page.body, "content_type": page.content_type})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("source", pa.string()), ("url", pa.string()), ("ok", pa.bool_()), ("reason", pa.string()), ("status", pa.int32()), ("body", pa.binary()), ("content_type", pa.string())]))

    return wanted.select(F.col("id").cast("long"), "source", "url").coalesce(1).sortWithinPartitions("id").mapInArrow(run, schema)


def write_page_cache(pages: DataFrame, folder: str) -> int:
    """Keeps the pages that could be had (id, source, ok, body) as <id>.<source>.htm; how many. They come at the pace of a polite
    fetcher, so one writer is enough; files are written through Hadoop's file system."""
    spark, n = pages.sparkSession, 0
    for r in pages.where("ok and body is not null").select("id", "source", "body").toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{r.id}.{r.source}.htm")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(r.body))
        out.close()
        n += 1
    return n


def json_lines(rows: DataFrame) -> DataFrame:
    """A JSON object for each row, nulls included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def read_page_cache(spark: SparkSession, folder: str) -> DataFrame:
    """id, source, body of the pages kept as <id>.<source>.htm."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    part = lambda i: F.regexp_extract(name, r"^(\d+)\.(\w+)\.htm$", i)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm").load(folder)
    return files.select(part(1).cast("long").alias("id"), part(2).alias("source"), F.col("content").alias("body")).where("id is not null")
