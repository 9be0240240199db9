"""Near-duplicate classes where a band key's members are mostly not linked, and ids with several texts."""

import random

import brute
import pytest

from babelcask.llm import near_dup


def classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df).collect()}


@pytest.mark.parametrize("left_over", [1.0, 1e9])
def test_large_group_of_unlinked_near_copies(spark, monkeypatch, left_over):
    """Copies of one text with 0 to 12 replaced words, and families far from the hub but near each other.

    With an endless ``LEFT_OVER`` nothing is joined by rounds: the differences find every link.
    """
    monkeypatch.setattr(near_dup, "LEFT_OVER", left_over)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(150)]

    def changed(text, n):
        text = list(text)
        for _ in range(n):
            text[rng.randrange(len(text))] = rng.choice(words)
        return text
    rows = [(i, " ".join(changed(base, rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 10])))) for i in range(500)]
    for f in range(40):
        far = changed(base, 12)
        rows += [(2000 + 10 * f + m, " ".join(changed(far, m))) for m in range(3)]
    assert classes(spark, rows) == brute.near_duplicate_classes(rows)


def test_a_member_has_one_hub(spark, monkeypatch):
    """Differences are made once per member that is left over, however many hubs its band keys have."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(150)]

    def changed(text, n):
        text = list(text)
        for _ in range(n):
            text[rng.randrange(len(text))] = rng.choice(words)
        return text
    rows = [(i, " ".join(changed(base, rng.choice([0, 2, 4, 6])))) for i in range(100)]
    for f in range(40):
        far = changed(base, 10)
        rows += [(1000 + 10 * f + m, " ".join(changed(far, m))) for m in range(3)]
    seen, write = {}, near_dup.Staging.write

    def kept(stage, df, name):
        seen[name] = write(stage, df, name)
        return seen[name]
    monkeypatch.setattr(near_dup.Staging, "write", kept)
    monkeypatch.setattr(near_dup, "LEFT_OVER", 1e9)
    assert classes(spark, rows) == brute.near_duplicate_classes(rows)
    members = [r["rep"] for r in seen["at_hubs"].collect()]
    assert len(members) == len(set(members)) and len(members) > 50
    hub = {r["rep"]: r["hub"] for r in seen["at_hubs"].collect()}
    by_key = {}
    for r in seen["rest1"].collect():
        by_key.setdefault(r["key"], set()).add(hub[r["rep"]])
    assert all(len(h) == 1 for h in by_key.values())      # members of one key meet


def test_an_id_with_several_texts_keeps_its_links(spark):
    w = [f"a{i}" for i in range(300)]
    rows = [(9, w[:100]), (5, w[:95]), (5, w[100:260]), (7, []), (7, w[100:255]), (8, None), (None, w[:100]), (11, [])]
    df = spark.createDataFrame([(d, None if t is None else " ".join(t)) for d, t in rows], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(9, 97, 5, False), (5, 92, 5, True), (5, 157, 5, True), (7, 0, 5, False), (7, 152, 5, False),
                          (8, 0, 8, True), (None, 97, None, True), (11, 0, 11, True)], key=str)


def test_sets_are_held_a_part_at_a_time(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 40)))) for i in range(60)] * 2
    whole = classes(spark, rows)
    monkeypatch.setattr(near_dup, "PART_SHINGLES", 50)
    assert [len(s) for _, s in near_dup._parts(iter([range(40)] * 3))] == [1, 1, 1]
    assert classes(spark, rows) == whole == brute.near_duplicate_classes(dict(rows).items())
