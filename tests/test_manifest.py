"""Manifests: each rule, texts that are no JSON, and minima."""

import json

from lumenframe.operators import manifest

GOOD = {"id": "a", "path": "raw/a", "sha256": "0", "vendor": "v", "camera": "c", "extension": "raw", "expect_route": "generic", "expect_layout": "bayer2x2", "expect_backend": "rawspeed3", "expect_error": "success", "license": "cc0"}


def test_findings(spark):
    bad = [GOOD, GOOD, GOOD | {"id": "b", "path": "/etc"}, GOOD | {"id": "c", "path": "a/../b"}, GOOD | {"id": "d", "expect_layout": None}, {k: v for k, v in GOOD.items() if k not in ("license", "id")}, GOOD | {"id": "e", "expect_error": "x"}]
    rows = [(1, json.dumps({"samples": bad})), (2, "{not json"), (3, None), (4, json.dumps({"other": 1})), (5, json.dumps({"samples": []})), (6, json.dumps({"samples": [GOOD]}))]
    s = manifest.samples(spark.createDataFrame(rows, "manifest_id int, text string"))
    got = sorted(map(tuple, manifest.schema_findings(s, ["success"]).collect()), key=str)
    want = [(1, "a", "duplicate id"), (1, "b", "path escapes"), (1, "c", "path escapes"), (1, "d", "bad layout -"), (1, None, "missing id"), (1, None, "missing license"), (1, "e", "bad error x")]
    assert got == sorted([*want, (2, None, "not a manifest"), (3, None, "not a manifest"), (4, None, "not a manifest")], key=str)
    missed = {r["manifest_id"]: 0 for r in manifest.coverage_findings(s, "success", "u").collect()}
    assert set(missed) == {1, 2, 3, 4, 5, 6}


def test_minima(spark):
    x = GOOD | {"expect_layout": "xtrans6x6"}
    full = [GOOD | {"id": f"malformed_{v}", "vendor": v} for v in "pqr"] + [x | {"id": "x1", "camera": "1"}, x | {"id": "x2", "camera": "2", "expect_backend": "libraw_native"}, GOOD | {"id": "u", "expect_error": "u"}]
    rows = [(1, json.dumps({"samples": full})), (2, json.dumps({"samples": full[1:]})), (3, json.dumps({"samples": [*full[:4], x | {"id": "x2", "camera": "1"}]}))]
    s = manifest.samples(spark.createDataFrame(rows, "manifest_id int, text string"))
    got = sorted(map(tuple, manifest.coverage_findings(s, "success", "u").collect()))
    assert got == [(2, "malformed 2 of 3"), (3, "fallbacks 0 of 1"), (3, "unsupported 0 of 1"), (3, "xtrans_cameras 1 of 2")]
