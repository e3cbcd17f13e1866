"""Remote shards, retries, recorded failures and the caches of headers and sketches."""

import http.server
import json
import os
import threading

import numpy as np
import pytest

from weftmark.operators import index
from weftmark.sources import ranges, safetensors


@pytest.fixture
def site(tmp_path):
    """A server over a folder that breaks the first connection to any path with ``broken`` in it."""
    broken = set()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path = self.path
            if "broken" in path and path not in broken:
                broken.add(path)
                self.connection.close()
                return
            file = str(tmp_path) + path
            if not os.path.isfile(file):
                self.send_error(404)
                return
            with open(file, "rb") as f:
                raw = f.read()
            asked = self.headers.get("Range")
            if asked:
                first, last = map(int, asked[6:].split("-"))
                raw = raw[first : last + 1]
            self.send_response(206 if asked else 200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", tmp_path
    server.shutdown()


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in files.items():
        safetensors.write(str(folder / f"{name.replace('_', '-')}.safetensors"), data)


def test_remote_shards(site, monkeypatch):
    monkeypatch.setattr(ranges, "BACKOFF", (0.01, 0.01, 0.01))
    url, folder = site
    w = {"a": np.arange(12.0).reshape(4, 3)}
    put(folder / "split", one=w, two={"b": np.ones(2)})
    (folder / "split" / "model.safetensors.index.json").write_text(json.dumps({"weight_map": {"a": "one.safetensors", "b": "two.safetensors"}}))
    assert safetensors.shards(f"{url}/split/") == [f"{url}/split/one.safetensors", f"{url}/split/two.safetensors"]
    put(folder / "single", model=w)
    assert safetensors.shards(f"{url}/single") == [f"{url}/single/model.safetensors"]
    put(folder / "me" / "listed" / "resolve" / "v1", x=w, y=w)
    (folder / "api" / "models" / "me" / "listed" / "revision").mkdir(parents=True)
    names = ("y.safetensors", "README.md", "x.safetensors")
    (folder / "api" / "models" / "me" / "listed" / "revision" / "v1").write_text(json.dumps({"siblings": [{"rfilename": n} for n in names]}))
    assert safetensors.shards("me/listed", url, "v1") == [f"{url}/me/listed/resolve/v1/{n}.safetensors" for n in "xy"]
    put(folder / "broken", model=w)
    assert safetensors.header(f"{url}/broken/model.safetensors")[0]["shape"] == [4, 3]
    with pytest.raises(OSError):
        safetensors.header(f"{url}/nowhere/model.safetensors")


def test_an_index_keeps_what_it_knows_and_records_failures(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(0)
    refs = {}
    for m in ("a", "b"):
        put(tmp_path / m, model={"model.layers.0.mlp.up_proj.weight": r.standard_normal((40, 24)), "norm.weight": r.standard_normal(24)})
        refs[m] = str(tmp_path / m)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "model.safetensors").write_bytes(b"\x03\x00\x00\x00\x00\x00\x00\x00{x}")
    refs |= {"bad": str(tmp_path / "bad"), "gone": str(tmp_path / "gone")}
    cache, passed = str(tmp_path / "cache"), []
    scan = index._scan
    monkeypatch.setattr(index, "_scan", lambda todo, **o: (passed.append((o.get("mode", "rows"), sorted(x["model"] for x in todo.collect()))), scan(todo, **o))[1])

    made, failures = index.build(index.universe_of(spark, refs), cache)
    first = {x["model"]: x["vector"] for x in made.collect()}
    assert sorted(first) == ["a", "b"] and sorted(x["model"] for x in failures.collect()) == ["bad", "gone"]
    assert passed == [("metadata", ["a", "b", "bad", "gone"]), ("rows", ["a", "b"])]

    passed.clear()
    again, _ = index.build(index.universe_of(spark, refs), cache)
    assert {x["model"]: x["vector"] for x in again.collect()} == first and passed == []

    put(tmp_path / "b", model={"model.layers.0.mlp.up_proj.weight": r.standard_normal((40, 24))})
    os.utime(tmp_path / "b" / "model.safetensors", ns=(1, 1))
    changed, _ = index.build(index.universe_of(spark, {m: refs[m] for m in "ab"}), cache)
    after = {x["model"]: x["vector"] for x in changed.collect()}
    assert passed == [("metadata", ["b"]), ("rows", ["b"])] and after["a"] == first["a"] and after["b"] != first["b"]


def test_an_unreadable_model_fails_a_scan_unless_recorded(spark, tmp_path):
    put(tmp_path / "a", model={"w": np.ones((300, 4))})
    both = {"a": str(tmp_path / "a"), "gone": str(tmp_path / "gone")}
    with pytest.raises(Exception, match="gone"):
        safetensors.scan(spark, both).collect()
    assert safetensors.scan(spark, both, on_error="record").count() == 300
    assert safetensors.scan(spark, both, on_error="record", max_rows=32).select("row_idx").distinct().count() == 32
