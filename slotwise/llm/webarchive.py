"""Web archives of a table of pages: written as ZIP packages, read back by range."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import zippack
from slotwise.llm.common import shared_folder, stored

_PACKAGES = "path string, records long, bytes long"
_PLACES = "path string, at long, lengths array<long>"
_RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
            "uri string, record_id string, refers_to_id string, payload binary")


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + re.sub("^file:", "", uri))


def _record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _page_id(record_id: str | None) -> int | None:
    """The page of an id that ``_record_id`` made; ids of other writers have none."""
    own = re.fullmatch(r"urn:page:(-?\d+)", record_id or "")
    return int(own[1]) if own else None


def with_first_copies(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Adds digest, and ``first``: the smallest page_id with an equal payload of at least ``min_bytes``, if repeated.

    Digests are counted in narrow rows with partial sums; the table of repeated
    payloads is joined to the pages, where adaptive execution broadcasts it if it
    is small and splits a frequent payload's rows if it isn't.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    long = base.filter(F.octet_length("html") >= min_bytes)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return base.join(firsts, "digest", "left")


def write_packages(pages: DataFrame, folder: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Writes every row as a record; returns the packages (path, records, bytes).

    Each task writes packages of about ``max_bytes`` under names of its own
    attempt. A package counts once its row is in the returned table, which is
    written before use, so what a failed or repeated task left behind is never
    read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _opened(folder)
        fs.create_dir(base)
        out, path, n = None, "", 0

        def done() -> pd.DataFrame:
            writer.close()
            out.close()
            return pd.DataFrame({"path": [f"{folder}/{path}"], "records": [n], "bytes": [writer.size]})

        for batch in batches:
            for page_id, url, html, digest, first in zip(
                    batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["first"]):
                if out is None:
                    path, n = f"{uuid.uuid4().hex}.wacz", 0
                    out = fs.open_output_stream(f"{base}/{path}")
                    writer = zippack.PackageWriter(out)
                page_id = None if page_id is None else int(page_id)
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
                revisit = first is not None and page_id != int(first)
                writer.add(uri, digest, zippack.make_record(
                    "revisit" if revisit else "response", _record_id(page_id), uri, digest, html.encode("utf-8", "surrogatepass"),
                    _record_id(int(first)) if revisit else None))
                n += 1
                if writer.size >= max_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stored(pages.select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("first").cast("string")).mapInPandas(run, _PACKAGES), "packages")


def read_packages(packages: DataFrame, payloads: bool = True, chunk: int = 8 << 20) -> DataFrame:
    """The records of the packages, read by range through their indexes: ``_RECORDS``.

    A task opens a package's directory and index and hands out places, near ones
    together up to ``chunk`` bytes, so reading spreads beyond one task a package:
    over as many tasks as there are shuffle partitions, or four chunks each.
    Every record in an index comes back, of any type (``record_type``) and any
    writer; ``page_id`` and ``refers_to`` are null where the ids, ``record_id`` and
    ``refers_to_id``, are not those of pages. A payload is the body of an HTTP
    message, without chunks, or the whole block of other records; it is checked
    against the digest a record gives in a known algorithm, and one that fails
    stops the job. ``payload_digest`` is its SHA-256; of revisits, which hold none,
    what the record says. ``payload`` is null for revisits, or everywhere without
    ``payloads``. No packages give no rows.
    """
    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, name = _opened(path)
                with fs.open_input_file(name) as f:
                    runs: list[list[int]] = []
                    for at, length, _ in sorted((x for x in zippack.index_lines(f)), key=lambda x: x[:2]):
                        if runs and runs[-1][0] + runs[-1][1] == at and runs[-1][1] < chunk:
                            runs[-1][1] += length
                            runs[-1][2].append(length)
                        else:
                            runs.append([at, length, [length]])
                yield pd.DataFrame({"path": path, "at": [r[0] for r in runs], "lengths": [r[2] for r in runs]})

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, at, lengths in zip(batch["path"], batch["at"], batch["lengths"]):
                fs, name = _opened(path)
                rows = []
                with fs.open_input_file(name) as f:
                    data = f.read_at(int(sum(lengths)), int(at))
                    start = 0
                    for length in lengths:
                        rows.append(_row(data[start:start + length], payloads))
                        start += length
                yield pd.DataFrame(rows, columns=_COLUMNS).astype(
                    {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    found = stored(packages.mapInPandas(places, _PLACES), "places")
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    total, n = found.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    # A stated number of parts: places are small rows, which would else be joined into few tasks whatever they point at.
    spread = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n, max(spread, -(-total // (4 * chunk)))))
    return found.repartition(parts, "path", "at").mapInPandas(records, _RECORDS)


_COLUMNS = [column.split()[0] for column in _RECORDS.split(", ")]


def _row(packed: bytes, payloads: bool) -> tuple:
    warc, http, body = zippack.parse_record(packed)
    kind, said = warc["warc-type"], warc.get("warc-payload-digest", "")
    record_id, refers_to = ((warc.get(name) or "").strip("<> ") or None for name in ("warc-record-id", "warc-refers-to"))
    if kind == "revisit":
        size = int(http["content-length"]) if http.get("content-length", "").isdecimal() else None
        digest, payload = said.removeprefix("sha256:") or None, None
    else:
        payload = zippack.unchunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body
        # Some writers digest the body as it was sent. Other types give the digest of another record's payload.
        if kind in ("response", "resource") and zippack.matches(payload, said) is False and not zippack.matches(body, said):
            raise ValueError(f"the payload of {record_id} does not match its digest {said}")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return (_page_id(record_id), size, digest, kind, _page_id(refers_to), warc.get("warc-target-uri"), record_id, refers_to,
            payload if payloads else None)


def archive_round_trip(pages: DataFrame, min_bytes: int = 100, payloads: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as packages in the shared folder and reads them back.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the
    smallest page_id is a response and the others revisits of it; shorter ones
    are all responses. A null html is empty, a null url an empty address. A null
    page_id is kept; it loses to any other, and rows that are all null among
    equals are all responses. Rows that repeat the smallest page_id are responses
    too. An empty table gives no package and no rows.
    """
    folder = f"{shared_folder(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    return read_packages(write_packages(with_first_copies(pages, min_bytes), folder), payloads)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
 CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""
