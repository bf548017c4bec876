"""Ball hashing against all pairs, and fingerprints against a plain restatement."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from parchmill.llm import queries
from parchmill.llm.simhash_dups import near_duplicates, near_links

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def mark(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, radius):
    marks = [(i, mark(t)) for i, t in rows]
    distinct = sorted({m for _, m in marks})
    parent = {m: m for m in distinct}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[top(a)] = top(b)
    least = {}
    for i, m in marks:
        if i is not None:
            least[top(m)] = min(i, least.get(top(m), i))
    return sorted(str((i, f"{m:016x}", least.get(top(m)))) for i, m in marks)


def got(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "fingerprint", "component_id").collect())


def test_query(spark, sf_dir, documents):
    found = queries.QUERIES["op11_simhash_dups"](spark, sf_dir)
    assert got(found) == expected([(r["doc_id"], r["text"]) for r in documents], 2)
    # There are both copies and documents that stand alone.
    sizes = [r["count"] for r in found.groupBy("component_id").count().collect()]
    assert max(sizes) > 1 and sizes.count(1) > 50


def edge_rows():
    rng = random.Random(3)
    texts = [None, "", " ", "a", "A  b", "é ß", "w " * 100_000]
    texts += [" ".join(rng.choice("the Of and a in\tto\n\n x".split(" ")) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts * 2)]
    return rows + [(500, "same text here again")] * 40


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_edges_copies_and_clashing_columns(make, radius):
    rows = edge_rows()
    clashing = dict(id="i", mark="m", component="c", fingerprint="f", component_id="x", vertex="v")
    assert got(near_duplicates(make(rows, **clashing), radius=radius)) == expected(rows, radius)


def test_component_without_an_id_and_empty_table(make):
    found = near_duplicates(make([(None, "x y z"), (None, "x y z"), (4, None), (2, "")])).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in found) == sorted(
        map(str, [(None, None), (None, None), (4, 2), (2, 2)])
    )
    assert near_duplicates(make([])).collect() == []


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_links_are_close_and_join_what_all_pairs_join(spark, radius):
    rng = random.Random(radius)
    values = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(15):  # chains
            values.append(x)
            for b in rng.sample(range(64), rng.randrange(1, radius + 2)):
                x ^= 1 << b
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = [(v,) for v in signed] + [(None,)]
    links = [(r["x"], r["y"]) for r in near_links(spark.createDataFrame(rows, "m long"), radius).collect()]
    assert len(set(links)) == len(links)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= radius for a, b in links)
    parents = [{v: v for v in set(signed)} for _ in range(2)]

    def top(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x

    all_pairs = [(a, b) for a in set(signed) for b in set(signed) if ((a ^ b) % (1 << 64)).bit_count() <= radius]
    for parent, pairs in zip(parents, (links, all_pairs), strict=True):
        for a, b in pairs:
            parent[top(parent, a)] = top(parent, b)
    groups = [{} for _ in parents]
    for parent, group in zip(parents, groups, strict=True):
        for v in parent:
            group.setdefault(top(parent, v), set()).add(v)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_a_group_of_copies_emits_one_ball(spark, make):
    rows = [(k, "one text that very many documents hold") for k in range(3000)]
    rows += [(k, f"another text number {k} of the table") for k in range(3000, 3020)]
    found = near_duplicates(make(rows))
    assert found.where("component_id = 0").count() >= 3000
    marks = found.select(F.conv("fingerprint", 16, -10).cast("long").alias("m")).where("m is not null")
    assert near_links(marks).count() < 100


def test_radius_has_bounds(make):
    with pytest.raises(ValueError, match="radius"):
        near_links(make([]).select("doc_id"), 5)
