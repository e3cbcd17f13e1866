"""Merged, overlapped and continued range requests, and what they cost, against a counting server."""

import http.server
import json
import os
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmark.operators import metrics
from weftmark.sources import ranges, safetensors


@pytest.fixture
def site(tmp_path):
    """A server that notes ranges, waits a little, and breaks off the first long answer to a path with ``short`` in it."""
    seen: list[tuple[str, int, int]] = []
    busy = {"now": 0, "most": 0}
    lock = threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            file = str(tmp_path) + self.path
            if not os.path.isfile(file):
                self.send_error(404)
                return
            with open(file, "rb") as f:
                raw = f.read()
            asked = self.headers.get("Range")
            with lock:
                busy["now"] += 1
                busy["most"] = max(busy["most"], busy["now"])
            time.sleep(0.01)
            if asked:
                first, last = map(int, asked[6:].split("-"))
                raw = raw[first : last + 1]
                with lock:
                    cut = "short" in self.path and len(raw) > 2000 and not any(x[0] == self.path and x[2] - x[1] > 2000 for x in seen)
                    seen.append((self.path, first, last + 1))
            self.send_response(206 if asked else 200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw[:1500] if asked and cut else raw)
            with lock:
                busy["now"] -= 1

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", tmp_path, seen, busy
    server.shutdown()


def test_merged_covers_every_range_within_its_limits():
    rng = random.Random(4)
    for _ in range(300):
        wanted = [(rng.choice("ab"), b := rng.randint(0, 4000), b + rng.choice([0, 1, 30, 200])) for _ in range(rng.randint(0, 30))]
        gap, free, share = rng.choice([-1, 0, 50, 500]), rng.choice([0, 100, 10**6]), rng.choice([0, 0.25, 2])
        spans = ranges.merged(wanted, gap, share, free)
        assert sorted(i for s in spans for i in s.inside) == [i for i, r in enumerate(wanted) if r[2] > r[1]]
        for s in spans:
            assert all(wanted[i][0] == s.file and s.begin <= wanted[i][1] and wanted[i][2] <= s.end for i in s.inside)
        for file in "ab":
            bytes_ = {x for f, b, e in wanted if f == file for x in range(b, e)}
            read = {x for s in spans if s.file == file for x in range(s.begin, s.end)}
            assert len(read - bytes_) <= free + share * sum(e - b for f, b, e in wanted if f == file)
        if gap < 0:
            assert len(spans) == sum(r[2] > r[1] for r in wanted)


def test_a_fifth_of_the_requests_for_the_same_rows(spark, site):
    url, folder, seen, busy = site
    rng = np.random.default_rng(0)
    tensors = {f"model.layers.{i}.w": rng.normal(size=(400, 8)) for i in range(12)} | {"model.norm.weight": rng.normal(size=8)}
    (folder / "m").mkdir()
    safetensors.write(str(folder / "m" / "model.safetensors"), tensors)
    rows = {}
    counts = {}
    for name, gap in (("each", "-1"), ("merged", str(64 << 10))):
        seen.clear()
        got = safetensors.scan(spark, {"m": f"{url}/m"}, max_rows=64, gap=gap).collect()
        rows[name] = sorted((r["tensor"], r["row_idx"], tuple(r["v"])) for r in got)
        counts[name] = sum(b > 8 for _, b, _ in seen)  # without the two of the header
    assert rows["each"] == rows["merged"] and len(rows["each"]) == 12 * 64 + 1
    assert counts["each"] == 12 * 16 + 1 and counts["merged"] * 5 <= counts["each"]
    assert busy["most"] > 1  # round trips overlapped
    want = {(t, i): x for t, a in tensors.items() for i, x in enumerate(np.atleast_2d(a).astype(np.float32))}
    assert all(np.array_equal(np.float32(v), want[t, i]) for t, i, v in rows["merged"])


def test_a_broken_answer_is_continued_alone(site):
    url, folder, seen, _ = site
    body = bytes(random.Random(1).randbytes(9000))
    (folder / "short.bin").write_bytes(body)
    got = ranges.read_span(f"{url}/short.bin", 100, 8000)
    assert got.raw == body[100:8000] and got.requests == 2
    assert [(b, e) for _, b, e in seen] == [(100, 8000), (1600, 8000)]


def test_metered_scan_feeds_the_cost_tables(spark, site):
    url, folder, seen, _ = site
    for m in ("a", "b"):
        (folder / m).mkdir()
        safetensors.write(str(folder / m / "model.safetensors"), {"w": np.arange(600000.0).reshape(60000, 10), "x": np.ones((3, 2))})
    models = {m: f"{url}/{m}" for m in "ab"} | {"c": str(folder / "a")}
    headers = safetensors.scan(spark, models, mode="metadata")
    rows = safetensors.scan(spark, models, max_rows=32, metered="true")
    plain = safetensors.scan(spark, models, max_rows=32)
    assert rows.drop("io").exceptAll(plain).isEmpty() and rows.count() == plain.count()
    seen.clear()
    cost = safetensors.transfer(rows, headers).collect()
    payload = [x for x in seen if x[1] > 8]
    assert {r["model"] for r in cost} == {"a", "b", "c"}
    for r in cost:
        mine = [e - b for p, b, e in payload if p.startswith(f"/{r['model']}/")]
        # headers are read while the scan is planned, outside of the rows' costs
        assert r["rows"] == 35 and r["full_size"] == 600000 * 4 + 24 and r["requests"] >= 1
        assert r["model"] == "c" or (r["bytes"], r["requests"]) == (sum(mine), len(mine))
    totals = metrics.transfer_totals(safetensors.transfer(rows, headers).withColumn("kind", F.lit("rows")), ["kind"]).collect()[0]
    assert totals["bytes"] == sum(r["bytes"] for r in cost) and totals["requests"] == sum(r["requests"] for r in cost)
    by = metrics.cost_by_method(safetensors.transfer(rows, headers).withColumn("method", F.lit("sample"))).collect()[0]
    assert by["n"] == 3 and by["total_bytes"] == totals["bytes"] and by["reduction"] > 1


def test_config_and_size_of_remote_checkpoints(site):
    url, folder, _, _ = site
    (folder / "m").mkdir()
    safetensors.write(str(folder / "m" / "model.safetensors"), {"w": np.ones((3, 4))})
    (folder / "m" / "config.json").write_text(json.dumps({"n_layer": 3}))
    assert safetensors.config(f"{url}/m") == safetensors.config(str(folder / "m")) == {"n_layer": 3}
    assert safetensors.total_size(f"{url}/m/") == safetensors.total_size(str(folder / "m"))
    assert safetensors.document(f"{url}/m/model.safetensors", "config.json") is not None
    assert safetensors.document(f"{url}/m", "README.md") is None and safetensors.config(str(folder)) == {}
