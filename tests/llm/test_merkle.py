"""The manifest against plain recursion, over rounds of blocks of several heights, and its edge cases."""

import zlib
from hashlib import sha256

import pytest

from palimpsest.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def climb(level, paths, tops):
    """Paths of all leaves below a level's nodes, run by run; the last node."""
    while len(level) > 1:
        for members, i in tops:
            run = i - i % 3
            before, after = level[run:i], level[i + 1 : run + 3]
            for m in members:
                paths[m].append((before, after))
        merged = {}
        for members, i in tops:
            merged.setdefault(i // 3, []).extend(members)
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        tops = [(merged[i], i) for i in range(len(level))]
    return level[0]


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> doc_id -> the query's columns."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(field, (*r[:4], text)))
    trees = {}
    for i, r in enumerate(rows):
        trees.setdefault(b"" if r[1] is None else b"1" + r[1].encode(), []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), i))
    paths, subroots, tops = {i: [] for i in range(len(rows))}, [], []
    for k, tree in enumerate(sorted(trees)):
        own = sorted(trees[tree])
        subroots.append(climb([x[2] for x in own], paths, [([x[3]], j) for j, x in enumerate(own)]))
        tops.append(([x[3] for x in own], k))
    sub = {m: subroots[k] for members, k in tops for m in members}
    root = climb(subroots, paths, tops)
    out = []
    for i, r in enumerate(rows):
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        d = leaf(r, r[4].replace("\n", "") if bad and r[4] is not None else r[4])
        for before, after in paths[i]:
            d = h(*before, d, *after)
        proof = h(*(x for before, after in paths[i] for x in (*before, *after)))
        out.append((r[0], leaf(r, r[4]), sub[i], root, proof, d, d == root))
    return sorted(out, key=repr)


TYPES = "doc_id long, source string, lang string, n_chars long, text string, root string, tree string, pos int, block int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, None) for r in rows], TYPES).repartition(5)


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_equals_plain_trees(spark, levels):
    rows = [(i, "hot", "en", 3, f"a\n{i}") for i in range(120)]
    rows += [(1000 + i, f"s{i % 7}", None if i % 3 else "de", None if i % 5 else i, None if i % 11 == 0 else "x\ny" * (i % 4)) for i in range(60)]
    rows += [(2000, None, None, None, None), (2001, "", "é", 1, "ñ" * 100_000 + "\n"), (None, "hot", "en", 1, "no id\n"), (2002, "alone", "fr", 2, "one\n")]
    rows += [(7, "hot", "en", 3, "other text of id 7")] * 4
    got = merkle.digests(table(spark, rows), levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 81, 82, 100, 243, 244, 800])
def test_fractal_paths_fold_to_the_root(n):
    leaves = [h(str(i)) for i in range(n)]
    paths = list(merkle.fractal_paths(leaves, merkle.height(n)))
    level = leaves
    while len(level) > 1:
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    assert len(paths) == n and all(merkle.fold(d, p) == level[0] for d, p in zip(leaves, paths, strict=True))
    assert merkle.proof_digest("") == sha256(b"").hexdigest()


def test_subtrees_stay_small(monkeypatch):
    """A stratum never holds more than its own levels' nodes."""
    most = []
    close = merkle.Growing.close
    monkeypatch.setattr(merkle.Growing, "close", lambda self: most.append(sum(map(len, close(self)))) or self.kept)
    list(merkle.fractal_paths([h(str(i)) for i in range(3**7)], 7))
    assert max(most) <= 3 + 9 + 27


def test_manifest_rows_and_empty(spark):
    rows = [(i, "a" if i % 2 else None, "en", 1, "t") for i in range(12)]
    got = merkle.manifest(merkle.leaves(table(spark, rows)), 1).collect()
    assert len(got) == 12 and all(merkle.fold(r.leaf, r.path) == r.root for r in got)
    assert merkle.digests(table(spark, [])).count() == 0
