"""A data source for safetensors checkpoints: headers as a table, tensor rows by byte range.

    spark.dataSource.register(SafetensorsSource)
    spark.read.format("safetensors").option("models", '{"a": "/path"}').option("mode", "metadata").load()
    spark.read.format("safetensors").option("models", ...).option("max_rows", 256).load()

A model is a folder, a file, a URL or a hub id (options ``endpoint`` and ``revision``).
Tables of headers are read by the tasks, one model each.  A scan of rows reads headers while
it is planned, sixteen models at a time; its tasks then read runs of rows of some 64 MB in
all: runs with small holes between them in one request (options ``gap`` and ``slack``), a
few requests at a time (``threads``).  With ``metered`` set to ``true`` the first row of
every request says what it cost (column ``io``), see :func:`transfer`.  Filters on model and tensor are pushed into the plan
(set spark.sql.python.filterPushdown.enabled).  With ``on_error`` set to ``record`` a model
that cannot be read has one row of headers with its ``error`` and no rows; else it fails the scan.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import re
import struct
import urllib.error
import urllib.parse
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from weftmark.sources import ranges
from weftmark.sources.ranges import fetch, is_url

#: Longest header that is believed.
MAX_HEADER = 512 << 20
#: Public model hub, and bytes of rows that one task reads.
HUB, TASK_BYTES = "https://huggingface.co", 64 << 20
_NUMPY = {
    "F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1",
    "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "<u1", "BOOL": "<u1",
}
ITEM = {k: np.dtype(v).itemsize for k, v in _NUMPY.items()} | {"BF16": 2} | dict.fromkeys(
    ("F8_E4M3", "F8_E4M3FN", "F8_E4M3FNUZ", "F8_E5M2", "F8_E5M2FNUZ"), 1
)


def float8(exponent_bits: int) -> np.ndarray:
    """All 256 values of an 8-bit float: 4 exponent bits without infinity, or 5 with infinity and NaN."""
    code = np.arange(256)
    mantissa_bits = 7 - exponent_bits
    bias = (1 << (exponent_bits - 1)) - 1
    sign = np.where(code & 128, -1.0, 1.0)
    e, m = (code >> mantissa_bits) & ((1 << exponent_bits) - 1), code & ((1 << mantissa_bits) - 1)
    part = m / (1 << mantissa_bits)
    value = sign * np.where(e == 0, part * 2.0 ** (1 - bias), (1 + part) * 2.0 ** (e - bias))
    top = e == (1 << exponent_bits) - 1
    if exponent_bits == 4:
        value[top & (m == 7)] = np.nan
    else:
        value[top] = np.where(m[top] == 0, sign[top] * np.inf, np.nan)
    return value


def decode(raw: bytes, dtype: str) -> np.ndarray:
    """A tensor's bytes as doubles."""
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32).astype(np.float64)
    if dtype.startswith("F8_E4M3"):
        return float8(4)[np.frombuffer(raw, np.uint8)]
    if dtype.startswith("F8_E5M2"):
        return float8(5)[np.frombuffer(raw, np.uint8)]
    if dtype not in _NUMPY:
        raise ValueError(f"dtype {dtype} is not supported")
    return np.frombuffer(raw, _NUMPY[dtype]).astype(np.float64)


def read_range(path: str, begin: int, end: int) -> bytes:
    """Bytes begin..end of a local file or a URL; a short read or an ignored range is an error."""
    return ranges.read_span(path, begin, end).raw


def _found(url: str) -> bytes | None:
    """Body of a small document, None where there is none."""
    try:
        return fetch(url)[1]
    except urllib.error.HTTPError as e:
        if e.code in (401, 403, 404):
            return None
        raise


def is_hub_id(ref: str) -> bool:
    """``owner/name`` that is no path on this machine."""
    return bool(re.fullmatch(r"[\w.-]+/[\w.-]+", ref)) and not ref.startswith(".") and not os.path.exists(ref)


def shards(path: str, endpoint: str = HUB, revision: str = "main") -> list[str]:
    """Shard files of a checkpoint folder, file, URL or hub id: by the index, else the single file, else all there are."""
    if path.endswith(".safetensors"):
        return [path]
    if is_url(path) or is_hub_id(path):
        listing = None if is_url(path) else f"{endpoint}/api/models/{path}/revision/{urllib.parse.quote(revision, safe='')}"
        return _remote_shards(_base(path, endpoint, revision), listing)
    index = os.path.join(path, "model.safetensors.index.json")
    if os.path.exists(index):
        with open(index, encoding="utf-8") as f:
            return [os.path.join(path, x) for x in sorted(set(json.load(f)["weight_map"].values()))]
    single = os.path.join(path, "model.safetensors")
    if os.path.exists(single):
        return [single]
    return [os.path.join(path, x) for x in sorted(os.listdir(path)) if x.endswith(".safetensors")]


def _base(path: str, endpoint: str, revision: str) -> str:
    """Where the documents of a remote checkpoint are."""
    if is_url(path):
        return path.rpartition("/")[0] if path.endswith(".safetensors") else path.rstrip("/")
    return f"{endpoint}/{path}/resolve/{urllib.parse.quote(revision, safe='')}"


def _remote_shards(base: str, listing: str | None) -> list[str]:
    index = _found(f"{base}/model.safetensors.index.json")
    if index is not None:
        return [f"{base}/{x}" for x in sorted(set(json.loads(index)["weight_map"].values()))]
    single = f"{base}/model.safetensors"
    if listing is None:
        return [single]
    names = sorted(x["rfilename"] for x in json.loads(fetch(listing)[1])["siblings"] if x["rfilename"].endswith(".safetensors"))
    return [single] if "model.safetensors" in names else [f"{base}/{x}" for x in names]


def header(file: str) -> list[dict]:
    """Tensors of a shard: name, dtype, shape, begin and end in the file."""
    size = struct.unpack("<Q", read_range(file, 0, 8))[0]
    if size > MAX_HEADER:
        raise ValueError(f"{file}: a header of {size} bytes")
    doc = json.loads(read_range(file, 8, 8 + size))
    base = 8 + size
    return [
        {"tensor": n, "dtype": t["dtype"], "shape": t["shape"], "begin": base + t["data_offsets"][0], "end": base + t["data_offsets"][1], "file": file}
        for n, t in doc.items() if n != "__metadata__"
    ]


def sampled_runs(n: int, max_rows: int | None, blocks: int = 16) -> list[tuple[int, int]]:
    """Runs of rows (first, after last) of the block-stratified sample; rows repeat in none."""
    if not max_rows or n <= max_rows:
        return [(0, n)] if n else []
    count = max(1, min(blocks, max_rows))
    per = max(1, max_rows // count)
    starts = np.rint(np.linspace(0, n - per, count)).astype(int) if count > 1 else [0]
    runs: list[tuple[int, int]] = []
    left = max_rows
    for s in map(int, starts):
        s = max(s, runs[-1][1] if runs else 0)
        e = min(s + per, n, s + left)
        if e > s:
            runs.append((s, e))
            left -= e - s
    return runs


@dataclass
class Run:
    """Consecutive rows of one tensor."""

    model: str
    tensor: str
    dtype: str
    file: str
    begin: int
    width: int
    first: int
    last: int

    @property
    def bytes(self) -> int:
        return (self.last - self.first) * self.width * ITEM.get(self.dtype, 8)


@dataclass
class Task(InputPartition):
    """What one task reads: the headers of a model, or runs of about ``TASK_BYTES`` in all."""

    model: str = ""
    path: str = ""
    runs: list[Run] = field(default_factory=list)


class SafetensorsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.models: dict[str, str] = json.loads(options["models"])
        self.metadata = options.get("mode", "rows") == "metadata"
        self.max_rows = int(options["max_rows"]) if "max_rows" in options else None
        self.record = options.get("on_error", "fail") == "record"
        self.hub = (options.get("endpoint", HUB).rstrip("/"), options.get("revision", "main"))
        self.metered = options.get("metered", "false") == "true"
        self.threads = int(options.get("threads", ranges.THREADS))
        self.limits = {k: kind(options[o]) for o, k, kind in (("gap", "gap", int), ("slack", "share", float), ("free", "free", int)) if o in options}
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("model", "tensor"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            else:
                yield f

    def _wanted(self, kind: str, value: str | None) -> bool:
        return kind not in self.only or value in self.only[kind]

    def _headers(self, path: str) -> tuple[list[dict], str | None]:
        """Wanted tensors of a checkpoint, and why it cannot be read if failures are recorded."""
        try:
            found = [t for file in shards(path, *self.hub) for t in header(file)]
        except (OSError, ValueError, KeyError, TypeError, struct.error, http.client.HTTPException) as e:
            if not self.record:
                raise
            return [], f"{type(e).__name__}: {e}"
        return [t for t in found if self._wanted("tensor", t["tensor"])], None

    def _runs(self, model: str, path: str) -> list[Run]:
        out = []
        for t in self._headers(path)[0]:
            shape = t["shape"]
            rows = shape[0] if len(shape) >= 2 else 1
            width = int(np.prod(shape[1:])) if len(shape) >= 2 else int(np.prod(shape or [1]))
            for first, last in sampled_runs(rows, self.max_rows):
                step = max(1, TASK_BYTES // max(1, width * ITEM.get(t["dtype"], 8)))
                for at in range(first, last, step):
                    out.append(Run(model, t["tensor"], t["dtype"], t["file"], t["begin"], width, at, min(at + step, last)))
        return out

    def partitions(self) -> list[InputPartition]:
        wanted = [(m, p) for m, p in sorted(self.models.items()) if self._wanted("model", m)]
        if self.metadata:
            return [Task(m, p) for m, p in wanted] or [Task()]
        tasks, held = [Task()], 0
        with ThreadPoolExecutor(16) as pool:
            for runs in pool.map(lambda x: self._runs(*x), wanted):
                for run in runs:
                    if tasks[-1].runs and held + run.bytes > TASK_BYTES:
                        tasks.append(Task())
                        held = 0
                    tasks[-1].runs.append(run)
                    held += run.bytes
        return tasks

    def read(self, task: Task) -> Iterator[tuple]:
        if self.metadata:
            if not task.model:
                return
            found, error = self._headers(task.path)
            for t in found:
                row = (task.model, t["tensor"], t["dtype"], t["shape"], t["begin"], t["end"], t["file"])
                yield (*row, None) if self.record else row
            if error is not None:
                yield task.model, None, None, None, None, None, None, error
            return
        spans = []
        for run in task.runs:
            step = run.width * ITEM[run.dtype]
            spans.append((run.file, run.begin + run.first * step, run.begin + run.last * step))
        for i, raw, got in ranges.read_merged(spans, self.threads, **self.limits):
            run = task.runs[i]
            io = (len(got.raw), got.requests, got.seconds) if got else None
            values = decode(raw, run.dtype).reshape(run.last - run.first, run.width)
            for at, row in enumerate(values):
                out = (run.model, run.tensor, run.first + at, row.tolist())
                yield (*out, io if at == 0 else None) if self.metered else out


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        if self.options.get("mode", "rows") == "metadata":
            error = ", error string" if self.options.get("on_error", "fail") == "record" else ""
            return f"model string, tensor string, dtype string, shape array<bigint>, begin bigint, end bigint, file string{error}"
        io = ", io struct<bytes:bigint,requests:bigint,seconds:double>" if self.options.get("metered", "false") == "true" else ""
        return f"model string, tensor string, row_idx bigint, v array<double>{io}"

    def reader(self, schema) -> SafetensorsReader:
        return SafetensorsReader(dict(self.options))


def scan(spark: SparkSession, models: dict[str, str], **options) -> DataFrame:
    """Read checkpoints by name with the options above, filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SafetensorsSource)
    return spark.read.format("safetensors").options(models=json.dumps(models), **options).load()


def transfer(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(model, rows, bytes, requests, seconds, full_size) of a metered scan, for the cost tables of ``metrics``.

    ``full_size`` are the bytes of all tensors by the headers.  Rows must come straight from
    the scan, as a dropped row may hold a cost.  A model of which nothing was read has zeros.
    """
    read = rows.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"io.{c}").alias(c) for c in ("bytes", "requests", "seconds")])
    total = headers.groupBy("model").agg(F.sum(F.col("end") - F.col("begin")).alias("full_size"))
    met = total.join(read, "model", "left")
    return met.select("model", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "bytes", "requests")], F.coalesce("seconds", F.lit(0.0)).alias("seconds"), "full_size")


def write(path: str, tensors: dict[str, np.ndarray], dtype: str = "F32") -> None:
    """A small checkpoint file, for tests and fixtures."""
    at, head, body = 0, {}, b""
    for name, x in tensors.items():
        raw = (x.astype("<f4").view("<u4") >> 16).astype("<u2").tobytes() if dtype == "BF16" else x.astype(_NUMPY[dtype]).tobytes()
        head[name] = {"dtype": dtype, "shape": list(x.shape), "data_offsets": [at, at + len(raw)]}
        at, body = at + len(raw), body + raw
    doc = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(doc)) + doc + body)


def write_models(rows: DataFrame, folder: str, dtype: str = "F64") -> dict[str, str]:
    """Write (model, tensor, row_idx, v) as checkpoints below a folder that all tasks can open; folders by model.

    A task writes one tensor as a shard of its own, under a name of its own first, so that a
    task that is run again leaves whole files.  Rows count from 0 without gaps.
    """
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"{folder}: checkpoints are written as files")
    root = folder.removeprefix("file://")

    def put(key: tuple, table: pa.Table) -> pa.Table:
        model, tensor = key[0].as_py(), key[1].as_py()
        table = table.sort_by("row_idx")
        x = np.array(table.column("v").to_pylist(), np.float64)
        place = os.path.join(root, hashlib.sha256(model.encode()).hexdigest()[:16])
        os.makedirs(place, exist_ok=True)
        name = os.path.join(place, f"{hashlib.sha256(tensor.encode()).hexdigest()[:16]}.safetensors")
        part = f"{name}.{uuid.uuid4().hex}.part"
        write(part, {tensor: x}, dtype)
        os.replace(part, name)
        return pa.table({"model": [model], "place": [place]})

    made = rows.select("model", "tensor", "row_idx", "v").groupBy("model", "tensor").applyInArrow(put, "model string, place string")
    return {r["model"]: r["place"] for r in made.distinct().collect()}


def total_size(path: str, endpoint: str = HUB, revision: str = "main") -> int:
    """Bytes of a checkpoint without reading its tensors: file sizes, or where the last tensor of a remote shard ends."""
    return sum(max((t["end"] for t in header(f)), default=0) if is_url(f) else os.path.getsize(f) for f in shards(path, endpoint, revision))


def document(path: str, name: str, endpoint: str = HUB, revision: str = "main") -> str | None:
    """A small text beside a checkpoint (config.json, README.md), None if there is none."""
    if is_url(path) or is_hub_id(path):
        raw = _found(f"{_base(path, endpoint, revision)}/{name}")
        return None if raw is None else raw.decode("utf-8", "replace")
    file = os.path.join(os.path.dirname(path) if path.endswith(".safetensors") else path, name)
    if not os.path.exists(file):
        return None
    with open(file, encoding="utf-8", errors="replace") as f:
        return f.read()


def config(path: str, endpoint: str = HUB, revision: str = "main") -> dict:
    """config.json of a checkpoint, empty if there is none."""
    text = document(path, "config.json", endpoint, revision)
    return json.loads(text) if text else {}
