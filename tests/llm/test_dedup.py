import random

import pytest

from fluxlake.llm import exact_dedup, near_dedup
from fluxlake.llm.components import components
from tests.llm import plain


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(plain.messy_rows(), plain.DOCS).repartition(3)


def test_exact_groups_on_difficult_rows(messy):
    rows = [(r[0], r[1]) for r in plain.messy_rows()]
    want = plain.exact(rows)
    got = exact_dedup.exact_groups(messy).collect()
    assert len(got) == len(rows)
    expected = sorted(str((i, *want["".join(plain.WORD.findall(t or ""))])) for i, t in rows)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == expected
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_rounds_with_small_strides(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(9)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.exact(rows)
    for r in exact_dedup.exact_groups(df, first_bytes=1, growth=2).collect():
        assert (r.keep_id, r.group_size, r.text_sha256) == want[dict(rows)[r.doc_id]]


def test_repeated_id_with_other_texts_is_kept_apart(spark):
    tail = "z" * 40
    rows = [(5, "a" * 9 + tail), (6, "a" * 9 + tail), (5, "b" * 9 + tail), (7, "b" * 9 + tail)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), first_bytes=4, growth=2)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(5, 5, 2), (5, 5, 2), (6, 5, 2), (7, 5, 2)]


def test_drop_copies_keeps_one_row_and_the_columns(messy):
    out = exact_dedup.drop_copies(messy)
    assert out.columns == messy.columns
    texts = ["".join(plain.WORD.findall(r.text or "")) for r in out.collect()]
    assert sorted(texts) == sorted(plain.exact([(r[0], r[1]) for r in plain.messy_rows()]))


def test_groups_are_told_apart_by_bytes_where_ids_are_missing(spark):
    """A third of the rows without id, and one id for another third: groups are numbered, not named by ids."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(6)) for _ in range(240)]
    rows = [((None, 1, i)[i % 3], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain.exact(rows)
    got = exact_dedup.exact_groups(df, first_bytes=1, growth=2).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == sorted(str((i, *want[t])) for i, t in rows)
    assert sorted(r.text for r in exact_dedup.drop_copies(df).collect()) == sorted(want)


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, near_dedup.drop_near_copies])
def test_dropping_copies_from_tables_with_the_modules_own_names(spark, drop):
    names = ["kept_id", "kept_sha", "kept_chars", "row", "sha", "id", "print", "node", "n", "part", "head", "a.b"]
    df = spark.createDataFrame([(i, f"text {i % 3} with some words", *names) for i in range(9)], ["doc_id", "text", *names])
    out = drop(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 1, 2]
    assert out.filter("`a.b` = 'a.b' AND kept_id = 'kept_id'").count() == 3


def test_near_groups_on_difficult_rows(spark):
    rows = [(r[0], r[1]) for r in plain.messy_rows() if r[0] is not None][:21]
    got = {r.doc_id: r for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.component_id for i, r in got.items()} == plain.near(rows)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(plain.shingles(t)) for i, t in rows}


def test_near_groups_with_nulls_and_repeats(messy):
    got = near_dedup.near_groups(messy).collect()
    assert len(got) == len(plain.messy_rows())
    assert {r.component_id for r in got if r.doc_id == 7} == {7}
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert near_dedup.drop_near_copies(messy).columns == messy.columns


def test_near_groups_keep_texts_without_id_and_under_one_id_apart(spark):
    rng = random.Random(8)
    a, b, c, d, e, f = (plain.prose(rng, 60) for _ in range(6))
    rows = [(1, a), (900, b), (None, a + " x"), (None, b + " x"), (None, c), (None, d), (None, d + " x"), (None, d.upper()),
            (5, e), (5, f), (3, e + " x"), (9, f + " x"), (20, c + " y"), (20, c), (20, c), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", exact_dedup.F.lit(1)).repartition(3)
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in near_dedup.near_groups(df).collect())
    named = [(1, 56, 1), (900, 56, 900), (None, 57, 1), (None, 57, 900), (None, 56, 20), (None, 56, None), (None, 57, None),
             (None, 56, None), (5, 56, 3), (5, 56, 5), (3, 57, 3), (9, 57, 5), (20, 57, 20), (20, 56, 20), (20, 56, 20),
             (None, 0, None), (None, 0, None)]
    assert sorted(x.rsplit(", ", 1)[0] for x in got) == sorted(str(x)[:-1] for x in named)
    out = near_dedup.drop_near_copies(df)
    assert out.columns == df.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    of_c, of_d = [x for x in left if (x[1] or "").startswith(c)], [x for x in left if (x[1] or "").lower().startswith(d)]
    assert len(of_c) == 1 and of_c[0][0] == 20 and len(of_d) == 1
    rest = [x for x in left if x not in of_c + of_d]
    assert sorted(map(str, rest)) == sorted(map(str, [(1, a), (900, b), (3, e + " x"), (5, f), (None, None), (None, "")]))


def test_near_groups_of_edited_copies_with_tiny_blocks(spark):
    """Hot buckets, chains just above and pairs just below the threshold, blocks that are crowded."""
    rng = random.Random(3)
    words = plain.prose(rng, 60).split(" ")
    rows = []
    for i in range(120):
        copy = list(words)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(60)] = f"e{rng.randrange(6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.near(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df, block=7).collect()}
    assert got == want
    assert len(set(want.values())) > 1


def test_crowded_blocks_give_a_forest_of_confirmed_links():
    import numpy as np
    import pandas as pd

    base = np.arange(100)
    sets = [base, np.append(base[:90], range(200, 205)), base + 1000, np.append(base[5:], range(300, 305))]
    group = pd.DataFrame({"node": [1, 2, 3, 4], "comp": [1, 2, 3, 4], "shingles": sets})
    got = near_dedup._block_links(group, 75, columns=16)
    assert sorted(map(tuple, got.to_numpy())) == [(1, 2), (1, 4)]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame(path + star, "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], plain.DOCS)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert near_dedup.near_groups(empty).count() == 0
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
