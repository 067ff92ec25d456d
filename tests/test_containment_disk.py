"""What greedy containment writes and shuffles stays in proportion to its texts, and common beginnings are told apart."""

import random
from pathlib import Path

from docmill import workers
from docmill.operators import anchored, greedy


def _shuffled(spark) -> int:
    store = spark.sparkContext._jsc.sc().statusStore()
    kind = spark._jvm.java.util.ArrayList()
    stages = store.stageList(kind, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), kind)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def _kept(rows: list[tuple]) -> list[tuple]:
    kept: dict = {}
    for q, o, t in sorted(rows):
        if not any(t in x or x in t for _, x in kept.setdefault(q, [])):
            kept[q].append((o, t))
    return sorted((q, o) for q, xs in kept.items() for o, _ in xs)


def test_texts_are_written_once_and_hardly_shuffled(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh 123456", k=6000)) for _ in range(300)]
    rows = [(k % 3, k, t) for k, t in enumerate(texts)] + [(k % 3, 1000 + k, texts[k][100:700]) for k in range(0, 300, 50)]
    rows = [(q, o, " ".join(t.split())) for q, o, t in rows]
    size = sum(len(t) for *_, t in rows)
    table = spark.createDataFrame(rows, "q long, o long, t string").coalesce(2)
    paths, written = [], workers.written

    def kept_path(df, name, **options):
        out = written(df, name, **options)
        paths.append(sum(f.stat().st_size for f in Path(out._docmill_path.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(anchored, "written", kept_path)
    monkeypatch.setattr(greedy, "written", kept_path)
    before = _shuffled(spark)
    got = greedy.containment_dedupe(table, "q", "o", "t").collect()
    moved = _shuffled(spark) - before
    assert sorted((r.q, r.o) for r in got) == _kept(rows)
    assert sum(paths) < size and moved < size / 3


def test_passages_of_common_grams_offer_all(spark, monkeypatch):
    """Texts with the same long beginning, copies in one task and in others, places that are taken twice."""
    rng = random.Random(8)
    head = "".join(rng.choices("abc é😀", k=400)).strip() + "x"
    rows = [(q, k, head + "".join(rng.choices("yz", k=rng.randint(1, 6)))) for q in range(2) for k in range(60)]
    rows += [(0, 100, head), (1, 101, head), (1, 5, head + "zz"), (1, 5, "a" + head), (0, 102, "yy"), (0, 103, "y")]
    first: dict = {}
    for q, o, t in sorted(rows):
        first.setdefault((q, o), t)
    want = _kept([(*key, t) for key, t in first.items()])
    table = spark.createDataFrame(rows, "q long, o long, t string").repartition(3)
    for few, common in ((anchored.FEW, anchored.COMMON), (1, 2), (3, 10**6)):
        monkeypatch.setattr(anchored, "FEW", few)
        monkeypatch.setattr(anchored, "COMMON", common)
        assert sorted(map(tuple, greedy.containment_dedupe(table, "q", "o", "t").collect())) == want
