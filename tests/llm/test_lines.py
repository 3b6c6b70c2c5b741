"""Line dedup against a plain version, and the index forwards and backwards."""

import numpy as np
import pyarrow as pa

from wordloom.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(rows, min_docs=3, min_chars=20):
    held = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (i is not None and len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != i)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_odd_texts(odd, none):
    got = lines.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert sum(r.n_dropped for r in got.collect()) > 0
    assert lines.dedup_lines(none).count() == 0


def table(df):
    return sorted(map(tuple, df.collect()))


def test_insert_and_delete_are_reversible(spark, monkeypatch):
    monkeypatch.setattr(lines, "GROUP_LINES", 2)
    text = lambda i: "\n".join(f"this is the shared line {k}" for k in range(i % 4)) + f"\nand the line of document {i}"
    rows = [(i, text(i)) for i in range(24)]
    docs = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    first = lines.LineIndex.build(docs(rows[:15]))
    both = first.insert(docs(rows[10:]))
    assert table(both.refs) == table(lines.LineIndex.build(docs(rows)).refs)
    back = both.delete(docs(rows[15:]))
    assert table(back.refs) == table(first.refs) and table(back.entries) == table(first.entries)
    # the filters' answers and keepers come back too, and only shards that a change crosses are written
    answers = lambda index: {(k, bool(held.contains(np.array([k], np.int64).view(np.uint64))[0]), int(x)) for r in index.shards()[0].toArrow().to_batches() for i in range(r.num_rows) for held, keys, keepers in [lines.read_shard(pa.table(r.slice(i, 1)))] for k, x in zip(keys[0].tolist(), keepers, strict=True)}
    assert answers(back) == answers(first) and answers(both) == answers(lines.LineIndex.build(docs(rows))) and all(a for _, a, _ in answers(both))
    assert table(both.fold().refs) == table(both.refs)
    got = lines.dedup_lines(docs(rows), index=both)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == plain(rows)


def test_a_change_writes_the_shards_it_touches(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    docs = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    rows = [(i, "\n".join(f"a line that three documents hold, number {k}" for k in range(40))) for i in range(3)]
    index = lines.LineIndex.build(docs(rows))
    assert index.shards()[1] == 10
    same = index.insert(docs([(0, "a line of one document only, and no other")]))
    assert same.touched.count() == 0
    one = index.insert(docs([(9, "a line that three documents hold, number 7")]))  # its keeper is another now
    assert one.touched.count() == 1 and one.shards()[0].count() == index.shards()[0].count()
    gone = one.delete(docs([(9, "")]).select("doc_id"))
    assert gone.touched.count() == 1
    assert index.delete(docs([(2, "")]).select("doc_id")).touched.count() == index.shards()[0].count()


def test_filter_holds_what_was_inserted_and_deletes():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    held = lines.CuckooFilter.of(keys)
    assert held.contains(keys).all()
    other = np.random.default_rng(2).integers(0, 2**63, 100_000, dtype=np.uint64)
    assert held.contains(other).mean() < 0.001
    held.delete(keys[:2500])
    assert held.contains(keys[2500:]).all() and held.contains(keys[:2500]).mean() < 0.01
    assert not lines.CuckooFilter(4).insert(keys)
