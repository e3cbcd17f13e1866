"""Dense kernels, merges, sketches and the checkpoint source."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmark import schema
from weftmark.functions import linalg
from weftmark.operators import direction, graph, merge, pairs, rights, sketch
from weftmark.sources import lineage, safetensors, texts

SF = "/root/testdata/sf0.001"
SHAPES = [(96, 64), (64, 96), (128, 128), (256, 64)]


def block(shape, seed):
    r = np.random.default_rng(seed)
    u = r.standard_normal((shape[0], min(shape))) * np.exp(-np.arange(min(shape)) / 12)
    return (u @ r.standard_normal((min(shape), shape[1]))) * r.lognormal(0, 0.8, (shape[0], 1))


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("trial", range(3))
def test_invariants_survive_permutation_and_scaling(shape, trial):
    r, w = np.random.default_rng(trial), block(shape, trial)
    moved = (w * r.uniform(0.25, 4, (shape[0], 1)) * r.uniform(0.25, 4, shape[1]))[r.permutation(shape[0])][:, r.permutation(shape[1])]
    a, b = linalg.tensor_invariants(w), linalg.tensor_invariants(moved)
    assert np.abs(a - b).max() <= 5e-2
    assert np.array_equal(a, linalg.tensor_invariants(w))
    assert np.abs(a - linalg.tensor_invariants(block(shape, trial + 50))).max() > 1e-2


def test_sinkhorn_and_spectrum():
    w = block((40, 30), 1)
    w[3] = 0
    s = linalg.sinkhorn(w, 200)
    rows = np.sqrt((s**2).sum(1))
    assert rows[3] == 0 and np.ptp(rows[rows > 0]) < 1e-5 and np.isclose(np.linalg.norm(s), 1)
    assert np.allclose(linalg.singular_values(w, 8), np.linalg.svd(w, compute_uv=False)[:8])
    big = block((500, 450), 2)
    assert np.allclose(linalg.singular_values(big, 5), np.linalg.svd(big, compute_uv=False)[:5], rtol=1e-3)
    values, vectors = linalg.gram_spectrum(w)
    assert np.isclose(linalg.subspace_energy(w, vectors, 30), 1) and 1 <= linalg.effective_rank(values) <= 30


def test_solvers():
    r = np.random.default_rng(3)
    t = r.standard_normal((4, 500))
    y = np.array([0.7, 0.3, 0, 0]) @ t
    w = linalg.nnls_l1(t @ t.T, t @ y, float(y @ y))
    assert np.abs(w - [0.7, 0.3, 0, 0]).max() < 1e-6
    assert np.allclose(linalg.project_simplex(np.array([0.2, 0.9, -1.0])), [0.15, 0.85, 0])
    z = r.standard_normal(500)
    free = linalg.nnls_gram(t @ t.T, t @ z)
    assert (free >= 0).all() and (t @ z - t @ t.T @ free).max() <= 1e-6
    x = r.standard_normal((200, 3))
    fitted = linalg.fit_logistic(x, (x @ [2.0, -1.0, 0.0] > 0).astype(float))
    assert fitted[0] > 0 > fitted[1]


def written_out_invariants(w, k):
    """The 32 features by their formulas, from a full decomposition and loops."""
    x = w.copy()
    for _ in range(64):
        for axis in (1, 0):
            norm = np.sqrt((x**2).sum(axis, keepdims=True))
            floor = max(1e-8 * norm.max(), np.finfo(float).tiny)
            x = np.where(norm > floor, x / np.maximum(norm, floor), 0.0)
        rows = np.sqrt((x**2).sum(1))
        live = rows[rows > 0]
        if live.max() - live.min() <= 1e-7 * live.max():
            break
    x = x / np.linalg.norm(x)
    short = min(x.shape)
    n = min(k, short)
    s = np.linalg.svd(x, compute_uv=False)[:n]
    out = [np.log10(s[int(np.rint(10 ** (np.log10(n) * i / 15))) - 1] / s[0] + 1e-12) for i in range(16)]
    p = s**2 / sum(s**2)
    out += [-sum(q * np.log(q) for q in p if q > 0) / np.log(n), (x**2).sum() / s[0] ** 2 / short, sum(s**2) ** 2 / sum(s**4) / n]
    profile = np.array([x.shape[1] * sum(r**4) / sum(r**2) ** 2 if sum(r**2) else 0.0 for r in x])
    v, m = np.sort(profile), len(profile)
    z = (profile - profile.mean()) / profile.std()
    out += [*np.quantile(profile / profile.mean(), np.linspace(0.05, 0.95, 8)), 2 * sum((i + 1) * v[i] for i in range(m)) / (m * sum(v)) - (m + 1) / m]
    return np.clip([*out, (z**4).mean() - 3, (z**3).mean(), ((s / s[0]) ** 3).mean(), ((s / s[0]) ** 4).mean()], -10, 10)


def trained_looking(seed, m, n):
    r = np.random.default_rng(seed)
    short = min(m, n)
    w = (r.standard_normal((m, short)) * np.exp(-np.arange(short) / max(1, short / 3))) @ r.standard_normal((short, n))
    return w * np.exp(0.4 * r.standard_normal((m, 1)))


@pytest.mark.parametrize("shape", ((44, 64), (48, 32), (96, 64), (256, 256), (64, 5)))
@pytest.mark.parametrize("k", (64, 16))
def test_invariants_follow_the_formulas(shape, k):
    w = trained_looking(sum(shape), *shape)
    assert np.allclose(linalg.tensor_invariants(w, k), written_out_invariants(w, k), atol=2e-4)
    w[3], w[:, 1] = 0.0, 0.0  # dead lines stay dead
    assert np.allclose(linalg.tensor_invariants(w, k)[[16, 17, 18, 30, 31]], written_out_invariants(w, k)[[16, 17, 18, 30, 31]], atol=2e-4)
    w[5, 2] = np.nan
    broken = linalg.tensor_invariants(w, k)
    w[5, 2] = 0.0
    assert (broken == linalg.tensor_invariants(w, k)).all()


def test_invariants_of_a_diagonal_and_of_nothing():
    v = np.array([3.0, -1.0, 2.0, 0.0])
    f = linalg.tensor_invariants(v, 2)
    p = np.array([9.0, 4.0]) / 13
    assert np.allclose(f[[0, 15, 16, 17, 18]], [0, np.log10(2 / 3), -(p * np.log(p)).sum() / np.log(2), 14 / 9 / 4, 1 / (p**2).sum() / 2], atol=1e-6)
    assert (linalg.tensor_invariants(np.zeros((4, 4)))[:16] == -10).all() and not linalg.tensor_invariants(np.zeros((0, 4))).any()


@pytest.mark.parametrize("shape", ((96, 64), (64, 96), (128, 128), (256, 64)))
def test_invariants_ignore_order_and_scale_but_not_the_model(shape):
    w = trained_looking(7, *shape)
    base = linalg.tensor_invariants(w, 48)
    for trial in range(3):
        r = np.random.default_rng(100 + trial)
        moved = r.uniform(0.25, 4, (shape[0], 1)) * w[r.permutation(shape[0])][:, r.permutation(shape[1])] * r.uniform(0.25, 4, (1, shape[1]))
        assert np.abs(linalg.tensor_invariants(moved, 48) - base).max() <= 0.05
    assert (linalg.tensor_invariants(w, 48) == base).all()
    assert np.abs(linalg.tensor_invariants(trained_looking(8, *shape), 48) - base).max() > 0.01


def test_merge_recovers_parents(spark):
    rows = lineage.tensor_rows(spark, SF)
    found = merge.decompose(rows, "merge2", ["sft", "cpt", "lora", "unrelated"], "root")
    assert set(found["selected"]) == {"sft", "cpt"} and abs(found["coefficients"]["sft"] - 0.6) < 1e-3
    assert found["coefficients"]["unrelated"] <= 0.05 and found["residual"] <= 0.05
    assert found == merge.decompose(rows, "merge2", ["sft", "cpt", "lora", "unrelated"], "root")
    guessed = merge.decompose(rows, "merge2", ["sft", "cpt"])
    assert abs(sum(guessed["coefficients"].values()) - 1) < 1e-9
    assert merge.decompose(rows, "merge2", ["missing"], "root")["selected"] == []


def test_direction_is_antisymmetric_and_right(spark):
    rows = lineage.tensor_rows(spark, SF)
    both = spark.createDataFrame([("root", "int8"), ("int8", "root"), ("root", "prune30"), ("prune30", "root"), ("root", "sft"), ("root", "root")], "a string, b string")
    got = {(r["a"], r["b"]): r for r in direction.verdict(direction.features(direction.collect_evidence(rows, both))).collect()}
    assert got["root", "int8"]["direction"] == "a->b" and got["int8", "root"]["direction"] == "b->a"
    assert got["root", "prune30"]["direction"] == "a->b" and got["root", "sft"]["direction"] == "unknown"
    for a, b in (("root", "int8"), ("root", "prune30")):
        assert got[a, b]["llr"] == -got[b, a]["llr"] and abs(got[a, b]["llr"]) >= schema.ABSTAIN
    assert got["root", "root"]["llr"] == 0


def test_sketch_distances(spark):
    rows = lineage.tensor_rows(spark, SF).where("model in ('root', 'sft', 'unrelated')")
    made = sketch.sketch(rows, k=16).cache()
    assert {len(r["vector"]) for r in made.collect()} == {schema.SKETCH_DIM}
    a, b = made.select(*[F.col(c).alias(f"{c}_a") for c in made.columns]), made.select(*[F.col(c).alias(f"{c}_b") for c in made.columns])
    d = sketch.sketch_distance("vector_a", "present_a", "vector_b", "present_b")
    got = {(r["model_a"], r["model_b"]): r["d"] for r in a.join(b).select("model_a", "model_b", d.alias("d")).collect()}
    assert abs(got["root", "root"]) < 1e-5 and abs(got["root", "sft"] - got["sft", "root"]) < 1e-9
    for metric in ("cosine", "ip", "l2"):
        assert sketch.search(made, made, 2, metric).where("rank = 1").count() == 3


def test_safetensors_round_trip(spark, tmp_path):
    r = np.random.default_rng(0)
    data = {"a.weight": r.standard_normal((40, 8)), "b.bias": r.standard_normal(5)}
    safetensors.write(str(tmp_path / "model.safetensors"), data)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(safetensors.SafetensorsSource)
    read = spark.read.format("safetensors").option("models", json.dumps({"m": str(tmp_path)}))
    head = {x["tensor"]: x for x in read.option("mode", "metadata").load().collect()}
    assert head["a.weight"]["shape"] == [40, 8] and head["b.bias"]["dtype"] == "F32"
    rows = read.option("mode", "rows").load()
    got = {(x["tensor"], x["row_idx"]): x["v"] for x in rows.collect()}
    assert len(got) == 41 and np.allclose(got["a.weight", 7], data["a.weight"][7].astype("f4"))
    assert rows.where("tensor = 'b.bias'").count() == 1
    few = read.option("max_rows", 16).load().where("tensor = 'a.weight'")
    assert few.count() == 16
    assert safetensors.total_size(str(tmp_path)) > 0 and safetensors.config(str(tmp_path)) == {}


def test_decoding():
    assert safetensors.float8(4)[0x7E] == 448 and np.isnan(safetensors.float8(4)[0x7F]) and safetensors.float8(5)[0x7B] == 57344
    assert np.isinf(safetensors.float8(5)[0x7C]) and safetensors.decode(b"\x80\x3f", "BF16")[0] == 1.0
    with pytest.raises(ValueError):
        safetensors.decode(b"", "C64")


def test_http_ranges():
    body, fail = bytes(range(200)), [1]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/flaky" and fail.pop() if fail and self.path == "/flaky" else False:
                self.send_response(503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            first, last = map(int, self.headers["Range"][6:].split("-"))
            self.send_response(200 if self.path == "/whole" else 206)
            self.end_headers()
            self.wfile.write(body[first : last + 1])

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert safetensors.read_range(url + "/x", 10, 20) == body[10:20]
    assert safetensors.read_range(url + "/flaky", 0, 5) == body[:5]
    with pytest.raises(OSError):
        safetensors.read_range(url + "/whole", 0, 5)
    with pytest.raises(OSError):
        safetensors.read_range(url + "/x", 190, 250)
    server.shutdown()


def test_rights_paths_and_wording(spark):
    edges = spark.createDataFrame([("nc-base", "mid", 0.90), ("mid", "leaf", 0.85)], "parent string, child string, confidence double")
    facts = rights.facts(spark.createDataFrame([("nc-base", "cc-by-nc-4.0"), ("mid", "apache-2.0"), ("leaf", "Apache 2")], "model string, declared string"))
    found = {(r["descendant"], r["ancestor"]): r for r in rights.conflicts(facts, edges).collect()}
    assert abs(found["leaf", "nc-base"]["confidence"] - 0.765) < 1e-9 and found["leaf", "nc-base"]["severity"] == "high"
    for r in found.values():
        text = r["message"].lower()
        assert "review" in text and not any(w in text for w in ("violat", "infring", "illegal"))
    effective = {r["model"]: r for r in rights.propagate(facts, edges).collect()}
    assert effective["leaf"]["commercial_use"] is False and effective["nc-base"]["commercial_use"] is False
    assert "inherited from nc-base: commercial use is excluded" in effective["leaf"]["restrictions"]


def test_cycles_and_reduction(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.3), ("a", "c", 0.7)], "parent string, child string, confidence double")
    left = graph.break_cycles(e)
    assert left.count() == 3
    kept, gone = graph.transitive_reduction(left)
    assert [(r["parent"], r["child"], r["via"]) for r in gone.collect()] == [("a", "c", "a -> b -> c")] and kept.count() == 2


def test_gate_and_universe_files(spark, tmp_path):
    d = spark.createDataFrame([("x", "p", 0.1), ("x", "q", 0.15), ("x", "far", 0.5), ("x", "none", float("inf"))], "child string, candidate string, delta double")
    assert {r["candidate"] for r in pairs.proximity_gate(d, 2.0).collect()} == {"p", "q"}
    assert pairs.proximity_gate(d, None).count() == 3
    (tmp_path / "u.txt").write_text('# c\n"a/b",\n\na/b\nc  # x\n')
    (tmp_path / "u.json").write_text('{"models": ["m1", {"path": "p2", "id": "i2"}, {"id": "i3"}, "m1"]}')
    refs = lambda f: [r["ref"] for r in texts.universe_file(spark, str(tmp_path / f)).orderBy("line_no").collect()]
    assert refs("u.txt") == ["a/b", "c"] and refs("u.json") == ["m1", "p2", "i3"]


def test_index_upkeep_is_idempotent(spark, tmp_path):
    from weftmark.streaming import index

    src, out = str(tmp_path / "in"), str(tmp_path / "idx")
    frame = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("a", [1.0])], "model string, vector array<double>")
    frame.write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(frame.schema).parquet(src)
        index.maintain(stream, out, str(tmp_path / "cp")).awaitTermination()
        frame.write.mode("append").parquet(src)
    assert sorted(r["model"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_models_and_indexes_are_stored(spark, tmp_path):
    from weftmark.operators import baselines, index

    path = str(tmp_path / "w.json")
    index.save_weights(path, {"lattice_asym": 2.0, "ghost": 1.0})
    loaded = index.load_weights(path)
    assert loaded["lattice_asym"] == 2.0 and loaded["zero_asym"] == 0.0 and "ghost" not in loaded
    made = spark.createDataFrame([("a", [1.0])], "model string, vector array<double>")
    index.save(made, str(tmp_path / "idx"))
    back = index.load(spark, str(tmp_path / "idx"))
    assert index.missing(back, spark.createDataFrame([("a",), ("z",)], "model string")).collect()[0]["model"] == "z"
    rows = lineage.tensor_rows(spark, SF)
    truth = spark.createDataFrame([("root", "int8", "a->b"), ("int8", "sft", "b->a"), ("root", "prune30", "a->b")], "a string, b string, truth string")
    feats = direction.features(direction.collect_evidence(rows, truth.select("a", "b"))).join(truth, ["a", "b"])
    assert index.fit_direction(feats)["lattice_asym"] > 0
    assert {r["direction"] for r in baselines.no_direction(truth).collect()} == {"unknown"}
    p = truth.select("a", "b").limit(1)
    for name, score in baselines.BASELINES.items():
        assert 0 <= score(rows.where("model in ('root', 'int8')"), truth.select("a", "b").where("a = 'root' and b = 'int8'")).collect()[0]["score"] <= 1.0001, name
    assert index.split_pairs(p).columns == ["a", "b", "test"]


def test_command_line(spark, tmp_path, capsys):
    from weftmark import cli

    r = np.random.default_rng(1)
    names = ["model.embed_tokens.weight", "model.layers.0.self_attn.q_proj.weight", "model.layers.0.mlp.down_proj.weight"]
    base = {n: block((96, 64), i) for i, n in enumerate(names)}
    step = {n: np.abs(w).max(1, keepdims=True) / 127 for n, w in base.items()}
    made = {
        "base": base, "quant": {n: np.rint(w / step[n]) * step[n] for n, w in base.items()},
        "tuned": {n: w + 0.03 * r.standard_normal(w.shape) * w.std() for n, w in base.items()}, "other": {n: block((96, 64), 90 + i) for i, n in enumerate(names)},
    }
    made["child"] = {n: w + 0.9 * (made["tuned"][n] - w) for n, w in base.items()}
    for name, tensors in made.items():
        (tmp_path / name).mkdir()
        safetensors.write(str(tmp_path / name / "model.safetensors"), tensors)
    (tmp_path / "base" / "README.md").write_text("---\nlicense: cc-by-nc-4.0\n---\n")
    (tmp_path / "quant" / "README.md").write_text("---\nlicense: mit\n---\n")
    at = lambda n: str(tmp_path / n)
    assert cli.main(["direction", at("base"), at("quant")]) == 0
    assert json.loads(capsys.readouterr().out)["direction"] == "a->b"
    assert cli.main(["decompose", at("child"), "--candidates", at("tuned"), at("other"), "--base", at("base")]) == 0
    assert json.loads(capsys.readouterr().out)["selected"] == ["tuned"]
    (tmp_path / "u.txt").write_text("\n".join(at(n) for n in ("base", "quant", "tuned", "other")))
    assert cli.main(["trace", at("quant"), "--universe", at("u.txt"), "--bom", at("bom.json")]) == 0
    text = capsys.readouterr().out
    assert "n_base" in text and "noncommercial_ancestor" in text and json.loads((tmp_path / "bom.json").read_text())["target"] == "quant"
    assert cli.main(["index", at("base"), at("other"), "--out", at("idx")]) == 0
