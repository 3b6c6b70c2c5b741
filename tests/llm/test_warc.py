"""Revisit resolution against a plain loop."""

import numpy as np
import pytest

from wordloom.llm import warc

SCHEMA = "id long, url string, date long, kind string, status int, headers map<string,string>, payload string, canonical int, part string"


def plain(rows):
    full = [r for r in rows if r[3] == "response" and r[4] == 200 and r[6] is not None and r[1] is not None and r[2] is not None]
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    out = {}
    for i, url, date, kind, _, headers, _ in rows:
        if kind != "revisit":
            continue
        own = low(headers)
        before = [r for r in full if url is not None and date is not None and r[1] == url and (r[2], r[0]) < (date, i)]
        if not before:
            out[i] = (None, "no earlier response", own, None)
            continue
        r = max(before, key=lambda r: (r[2], r[0]))
        stored = low(r[5])
        bare = lambda e: e.removeprefix("W/") if e else e
        if "etag" not in own and "last-modified" not in own:
            out[i] = (None, "no validator", own, None)
        elif (bare(own["etag"]) == bare(stored.get("etag"))) if "etag" in own else (own["last-modified"] == stored.get("last-modified")):
            out[i] = (r[0], None, {**stored, **{k: v for k, v in own.items() if k not in warc.FORBIDDEN}}, r[6])
        else:
            out[i] = (None, "validator mismatch", own, None)
    return out


@pytest.mark.parametrize("range_rows", [7, 50_000])
def test_resolution(spark, range_rows):
    rng = np.random.default_rng(range_rows)
    rows = []
    for i in range(400):
        url = None if i % 97 == 0 else f"h.example/{0 if i % 3 else rng.integers(0, 9)}"  # one address has most captures
        date = None if i % 89 == 0 else int(rng.integers(0, 150))
        if rng.random() < 0.3:
            payload = None if rng.random() < 0.1 else f"body {i}"
            rows.append((i, url, date, "response", int(rng.choice([200, 200, 200, 404])), {"ETag": f'"{rng.integers(0, 3)}"', "Last-Modified": f"d{rng.integers(0, 2)}", "Content-Length": str(i), "X": "kept"}, payload))
        else:
            h = [None, {"etag": f'W/"{rng.integers(0, 3)}"', "content-length": "0"}, {"Last-Modified": f"d{rng.integers(0, 2)}", "Expires": str(i)}, {"expires": "x"}][rng.integers(0, 4)]
            rows.append((i, url, date, "revisit", 304, h, None))
    want = plain(rows)
    extra = [(*r, 1, "x") for r in rows] + [(*rows[1], 1, "x"), (None, "h.example/0", 3, "revisit", 304, None, None, 1, "x"), (9000, "h.example/0", 3, None, 304, None, None, 1, "x")]
    got = warc.resolve_revisits(spark.createDataFrame(extra, SCHEMA).repartition(3), range_rows).collect()
    assert len(got) == len(want)
    assert {r.id: (r.refers_to, r.reason, r.headers, r.payload) for r in got} == want
    assert {reason for _, reason, _, _ in want.values()} == {None, "no earlier response", "no validator", "validator mismatch"}


def test_nothing(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("url", "want"), [("HTTPS://WWW.Ex.org:443/a/?b=2&a=1&utm_source=x#f", "ex.org/a?a=1&b=2"), ("http://ex.org", "ex.org"), ("ex.org/A/", "ex.org/A"), ("http://ex.org?q=1", "ex.org?q=1"), ("", ""), (None, None)])
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.canonical_url(df.u)).first()[0] == want
