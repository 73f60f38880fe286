import collections
import hashlib
import random

from fluxlake.llm import chat, mixing, quality_rules
from tests.llm import plain


def counts(text):
    words = plain.WORD.findall(text or "")
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i:i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if plain.WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_rules_count_like_plain_python(spark):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in plain.messy_rows()]
    rows += [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "a b c ", "# ", "\x0b", "a\n", "…"]) for _ in range(rng.randrange(60))))
             for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", mixing.F.lit(1))
    got = quality_rules.quality_rules(df).collect()
    want = sorted(str((i, *counts(t))) for i, t in rows)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_rules_judge_by_the_table(spark):
    good = " ".join(["the", "of", "and", "to", *(f"word{i}" for i in range(60))])
    rows = [(1, good), (2, good.replace("word", "w###")), (3, good.upper()), (4, (good + "!!").replace(" ", "!! "))]
    got = {r.doc_id: (r.kept, r.reason) for r in quality_rules.quality_rules(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (True, None), 2: (False, "symbol_ratio"), 3: (False, "capital_ratio"), 4: (False, "shout_ratio")}
    assert quality_rules.quality_rules(spark.createDataFrame([], plain.DOCS)).count() == 0


def test_rules_count_stop_words_per_word_and_capitals_among_letters(spark):
    rng = random.Random(6)
    keywords = " ".join(f"key{i}" for i in range(3000)) + " de la"
    title = " ".join(["The", "Of", "And", "To", *(f"word{i}" for i in range(60))])
    diluted = " ".join(["the", "of", "and", "to", *(f"SHOUT{i:05d}%" for i in range(6)), *(f"LOUD{i:09d}" for i in range(50))])
    rows = [(1, keywords), (2, title), (3, diluted)]
    got = {r.doc_id: (r.kept, r.reason) for r in quality_rules.quality_rules(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, "stop_ratio"), 2: (True, None), 3: (False, "capital_ratio")}
    pool = ["The", "DE", "la", "und", "Des", "qui", "word", "WORD", "x1", "É", "\u212aey", "\n", "thé"]
    rows += [(10 + i, " ".join(rng.choices(pool, k=rng.randrange(80)))) for i in range(100)] + [(500, None), (501, "1 2")]
    stats = quality_rules.ratios(quality_rules.base_statistics(spark.createDataFrame(rows, "doc_id long, text string")))
    for r in stats.select("doc_id", "stop_ratio", "capital_ratio").collect():
        text = dict(rows)[r.doc_id] or ""
        words = plain.WORD.findall(text)
        stops = max(sum(w.lower() in listed for w in words) for listed in quality_rules.STOP_WORDS.values())
        upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
        assert r.stop_ratio == (stops / len(words) if words else 0)
        assert r.capital_ratio == (upper / (upper + lower) if upper + lower else 0)


def talks():
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        n = rng.choice([1, 2, 5, 40, 700])
        lead = ["system"] if conv % 3 == 0 else []
        roles = lead + [rng.choice(["user", "assistant"]) for _ in range(n)]
        rows += [(conv, t, r, plain.prose(rng, rng.randrange(80)) + rng.choice(["", "\\", "</turn>\n", "<turn a>", "\\1"]))
                 for t, r in enumerate(roles)]
    rows += [(50, 0, "system", "only"), (51, 0, "assistant", "x" * 9000), (51, 1, "assistant", None), (52, None, None, "t"),
             (52, 3, "assistant", "a"), (52, 3, "assistant", "a"), (None, 0, "assistant", "n"), (None, 1, "user<>", "")]
    return rows


def test_windows_read_back_exactly_and_keep_the_budget(spark):
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", mixing.F.lit("x"))
    for budget, history in ((200, 60), (2048, 512)):
        windows = chat.chat_windows(df.repartition(3), budget, history)
        got = {r.conv_id: r for r in chat.read_back(windows).collect()}
        by_conv = collections.defaultdict(list)
        for c, t, role, text in rows:
            by_conv[c].append((t is None, t or 0, role or "", text or ""))
        for conv, turns in by_conv.items():
            turns.sort()
            loss = "".join(x for _, _, role, x in turns if role == "assistant")
            whole = "".join(f"{role}\n{x}\n" for _, _, role, x in turns)
            r = got[conv]
            assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        for w in windows.collect():
            assert w.formatted.count("</turn>\n") == w.n_context + w.n_new
            assert not w.over_budget or w.n_new == 1
            if w.conv_id is not None and w.conv_id < 12 and w.conv_id % 3 == 0:
                assert w.formatted.startswith("<turn system>")
        assert windows.filter("n_context > 0").count() > 0


def test_chat_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.chat_windows(empty)).count() == 0


def mix_rows():
    rng = random.Random(9)
    rows = [(i, plain.prose(rng, rng.randrange(1, 60)), rng.choice(["a", "b", "b", "b", "é", None])) for i in range(600)]
    return [*rows, (600, None, "b"), (601, " ", None), rows[5], (None, "one two", "a")]


def test_mix_meets_the_targets(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(mix_rows())
    size = collections.Counter()
    for _, text, source in mix_rows():
        size[source] += len(plain.WORD.findall(text or ""))
    target = {r.source_size: r.target for r in got}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, free, left = {}, set(size), 1.5 * sum(size.values())
    while True:  # share, cap, share again
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        want.update({s: 2 * size[s] for s in full} or {s: level * weight[s] for s in free})
        if not full:
            break
        free -= full
        left -= sum(2 * size[s] for s in full)
    assert {size[s]: round(want[s], 6) for s in size} == {k: round(v, 6) for k, v in target.items()}
    for s in size:
        own = [r for r in got if r.source_size == size[s]]
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert all((r.position is None) == (r.taken == 0) for r in got)
    again = mixing.mix_plan(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_rows_follow_the_schedule(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string").withColumn("size", mixing.F.lit("s"))
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    plan = {r.doc_id: r.n_passes for r in mixing.mix_plan(df).collect() if r.doc_id not in (None, 5)}
    seen = collections.Counter(r.doc_id for r in out.collect())
    assert all(seen[i] == n for i, n in plan.items())
    # the first source by rank is front-loaded: more than half of its words come in the first half
    rows = mixing.planned(mixing._narrow(df)).filter("__mix_source = 'a'").selectExpr("inline(__mix_passes)").collect()
    early = sum(r.words for r in rows if r.position < 0.5)
    assert 0.58 < early / sum(r.words for r in rows) < 0.67  # the integral gives 0.625
    assert mixing.mix_plan(spark.createDataFrame([], plain.DOCS)).count() == 0


def test_mix_plan_is_range_sorted_with_all_positions(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string").repartition(4)
    plan = mixing.mix_plan(df)
    rows = plan.withColumn("part", mixing.F.spark_partition_id()).collect()
    places = [(r.position is None, r.position or 0.0) for r in sorted(rows, key=lambda r: r.part)]
    assert places == sorted(places)
    assert all((r.last_position is None) == (r.n_passes == 0) for r in rows)
    assert all(r.last_position > r.position for r in rows if r.n_passes == 2)
    assert all(r.last_position == r.position for r in rows if r.n_passes == 1)


def test_mix_deals_texts_without_id_apart(spark):
    rows = [(None, f"text number {i}", "a") for i in range(300)] + [(i, "one two", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slices = mixing._narrow(df).filter("__mix_id IS NULL").select("__mix_slice").distinct().count()
    assert slices > 200
    assert mixing.mix_documents(df.withColumn("__mix_size", mixing.F.lit(1))).columns[-1] == "__mix_size"


def test_chat_of_tied_turns_and_a_hot_conversation(spark):
    """Equal turn numbers by role and text as they are, not as they are printed; most rows without conversation and turn."""
    rows = [(1, 0, "user", t) for t in ("a!", "a", "a<", "a=", "a\\")] + [(1, 0, "assistant", "z")]
    rows += [(None, None, "user", f"{i % 7} words") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for r in chat.read_back(chat.chat_windows(df, 40, 10)).collect():
        turns = sorted(x[2:] for x in rows if x[0] == r.conv_id)
        whole = "".join(f"{role}\n{x}\n" for role, x in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())


def test_words_in_many_languages_and_capitals_of_the_threshold_table(spark):
    """The operator's own forms of two rules: stop words per word in any case, capitals among letters."""
    lean = "keyword " * 98 + "de la"
    shout = "THE WORD OF 12345678 IS THE WORD OF 12345678 " * 8
    rows = [(1, " ".join(f"{w}{i}" for i, w in enumerate(lean.split())) + " de la"), (2, " ".join(f"{w}{i}" for i, w in enumerate(shout.split())))]
    got = {r.doc_id: r.reason for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "stop_ratio", 2: "capital_ratio"}
