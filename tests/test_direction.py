"""The whole direction evidence against plain numpy, and checkpoints that only headers or new rows can orient."""

import json

import numpy as np

from weftmark import schema
from weftmark.operators import direction
from weftmark.sources import safetensors

EMBED, Q, DOWN = "model.embed_tokens.weight", "model.layers.0.self_attn.q_proj.weight", "model.layers.0.mlp.down_proj.weight"


def universe():
    r = np.random.default_rng(5)
    base = {n: r.standard_normal((40, 16)) * r.lognormal(0, 0.8, (40, 1)) for n in (EMBED, Q, DOWN)}
    child = {n: w + 0.05 * r.standard_normal(w.shape) for n, w in base.items()}
    child[EMBED] = np.vstack([child[EMBED], 0.02 * r.standard_normal((12, 16))])
    child["model.layers.0.mlp.down_proj.Weight_Scale"] = r.standard_normal((40, 2))
    return {"base": base, "child": child}


def spectrum(x):
    values = np.linalg.eigvalsh(x.T @ x)[::-1].clip(0)
    p = values[values > 0] / values.sum()
    return np.exp(-(p * np.log(p)).sum()) / min(x.shape), values[:48].sum() / values.sum()


def brute(made, bits):
    """The seven features beside the values, by hand."""
    base, child = made["base"], made["child"]
    total, acc = 0, np.zeros(7)
    for n in (EMBED, Q, DOWN):
        a, b = base[n], child[n][:40]
        d = b - a
        energy = lambda x: ((d @ np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :48]) ** 2).sum() / (d**2).sum()  # noqa: B023, E731
        (ra, ma), (rb, mb), (rd, _) = spectrum(a), spectrum(b), spectrum(d)
        acc += a.size * np.array([energy(a), energy(b), ra, rb, rd, ma, mb])
        total += a.size
    ea, eb, ra, rb, rd, ma, mb = acc / total
    norm = lambda x, y: (y - x) / (abs(x) + abs(y) + 1e-12)
    own = np.linalg.norm(child[EMBED][40:], axis=1)
    known = np.linalg.norm(child[EMBED][:40], axis=1)
    at = np.concatenate([own, known])
    ks = max(abs((own <= x).mean() - (known <= x).mean()) for x in at)
    tight = (abs(own - np.median(own)) <= 3 * np.median(own) / np.sqrt(32)).mean()
    return {
        "vocab_delta": np.tanh(12 / 128), "orphan_asym": min(1, 0.5 * tight + 0.5 * ks), "dtype_precision_asym": (bits["base"] - bits["child"]) / 32,
        "subspace_energy_asym": norm(ea, eb), "delta_rank_asym": norm(rd / ra, rd / rb), "spectral_growth_asym": norm(ma, mb),
        "exact_tie_asym": 0.5 * 2 / 4,
    }


def test_every_feature_against_numpy(spark):
    made = universe()
    cells = [(m, n, i, row.tolist()) for m, ts in made.items() for n, w in ts.items() for i, row in enumerate(w)]
    rows = spark.createDataFrame(cells, "model string, tensor string, row_idx long, v array<double>")
    types = {"base": "F32", "child": "BF16"}
    headers = spark.createDataFrame([(m, n, types[m], list(w.shape)) for m, ts in made.items() for n, w in ts.items()], "model string, tensor string, dtype string, shape array<bigint>")
    both = spark.createDataFrame([("base", "child"), ("child", "base")], "a string, b string")
    got = {r["a"]: r for r in direction.verdict(direction.features(direction.collect_evidence(rows, both, headers))).collect()}
    for name, want in brute(made, {"base": 32, "child": 16}).items():
        assert want != 0 or name in ("subspace_energy_asym", "spectral_growth_asym"), name
        assert abs(got["base"][name] - want) < 1e-9, (name, got["base"][name], want)
        assert got["child"][name] == -got["base"][name]
    assert got["base"]["direction"] == "a->b" and got["child"]["direction"] == "b->a"
    assert set(got["base"]["contributions"]) == set(schema.DIRECTION_WEIGHTS)


def test_wide_spectra_against_numpy(spark):
    """Width above 48, where the leading subspace is not the whole space."""
    r = np.random.default_rng(8)
    a = r.standard_normal((90, 70)) * np.exp(-np.arange(70) / 20)
    b = a + 0.1 * r.standard_normal(a.shape)
    rows = spark.createDataFrame([(m, Q, i, row.tolist()) for m, w in (("a", a), ("b", b)) for i, row in enumerate(w)], "model string, tensor string, row_idx long, v array<double>")
    got = direction.spectral_evidence(rows, spark.createDataFrame([("a", "b")], "a string, b string")).collect()[0]
    (ra, ma), (rb, mb), (rd, _) = spectrum(a), spectrum(b), spectrum(b - a)
    energy = lambda x: (((b - a) @ np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :48]) ** 2).sum() / ((b - a) ** 2).sum()
    want = {"subspace_energy_a": energy(a), "subspace_energy_b": energy(b), "delta_rank_a": rd / ra, "delta_rank_b": rd / rb, "top_mass_a": ma, "top_mass_b": mb}
    for name, value in want.items():
        assert 0 < value and abs(got[name] - value) < 1e-9, name


def test_pairs_without_shared_tensors_keep_their_headers(spark):
    rows = spark.createDataFrame([("x", Q, 0, [1.0, 2.0]), ("y", DOWN, 0, [1.0, 2.0])], "model string, tensor string, row_idx long, v array<double>")
    headers = spark.createDataFrame([("x", Q, "F32", [8, 2]), ("y", DOWN, "I8", [8, 2])], "model string, tensor string, dtype string, shape array<bigint>")
    got = direction.verdict(direction.features(direction.collect_evidence(rows, spark.createDataFrame([("x", "y")], "a string, b string"), headers))).collect()
    assert len(got) == 1 and got[0]["dtype_precision_asym"] == 0.75 and got[0]["direction"] == "a->b"


def test_command_line_sees_precision_and_vocabulary(spark, tmp_path, capsys):
    from weftmark import cli

    made = universe()
    base = {n: (w.astype("<f4").view("<u4") & 0xFFFF0000).view("<f4") for n, w in made["base"].items()}
    wider = base | {EMBED: np.vstack([base[EMBED], made["child"][EMBED][40:]])}
    for name, tensors, dtype in (("base", base, "F32"), ("half", base, "BF16"), ("wider", wider, "F32")):
        (tmp_path / name).mkdir()
        safetensors.write(str(tmp_path / name / "model.safetensors"), tensors, dtype)
    for child in ("half", "wider"):
        for a, b, want in (("base", child, "a->b"), (child, "base", "b->a")):
            assert cli.main(["direction", str(tmp_path / a), str(tmp_path / b)]) == 0
            assert json.loads(capsys.readouterr().out)["direction"] == want, (a, b)
