import re

import pytest
from pyspark.sql import functions as F

from pagemart.llm import line_dedup

from .conftest import prose, rows_of


def words(line):
    return set(re.findall(r"[^\x20\x09-\x0D]+", line))


def brute_force(rows, tie):
    """Lines that go: an earlier line has a Jaccard index of 4/5 with them."""
    documents = sorted(
        {(r[0] is not None, r[0] or 0, tie[r[1]], r[1]) for r in rows if r[1] is not None}
    )
    earlier, found = [], {}
    for known, doc_id, _, text in documents:
        numbers = []
        for no, line in enumerate(text.split("\n")):
            own = words(line)
            if not own:
                continue
            if any(100 * len(own & o) >= 80 * len(own | o) for o in earlier):
                numbers.append(no)
            earlier.append(own)
        found[(doc_id if known else None, text)] = numbers
    return found


def expected(rows, tie):
    gone = brute_force(rows, tie)
    result = []
    for doc_id, text, *_ in rows:
        numbers = gone.get((doc_id, text), [])
        lines = (text or "").split("\n")
        counted = sum(bool(words(line)) for line in lines)
        if numbers:
            text = "\n".join(x for i, x in enumerate(lines) if i not in numbers)
        result.append((doc_id, text, counted, len(numbers)))
    return sorted(map(repr, result))


def check(spark, rows, frame):
    texts = sorted({r[1] for r in rows if r[1] is not None})
    ties = spark.createDataFrame([(t,) for t in texts], "text string")
    tie = {r[0]: r[1] for r in ties.select("text", F.xxhash64("text")).collect()}
    found = line_dedup.deduplicated(frame).collect()
    got = [(r["doc_id"], r["text"], r["n_token_lines"], r["n_removed"]) for r in found]
    assert sorted(map(repr, got)) == expected(rows, tie)


def test_against_brute_force(spark, documents, awkward):
    check(spark, awkward, documents)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_lines_against_brute_force(spark, seed):
    import random

    draw = random.Random(seed)
    lines = [prose(seed * 100 + i, draw.randint(1, 30), 60).replace("\n", " ") for i in range(40)]
    rows = []
    for doc_id in range(40):
        chosen = []
        for _ in range(draw.randint(0, 6)):
            tokens = draw.choice(lines).split(" ")
            for _ in range(draw.randint(0, 4)):
                tokens[draw.randrange(len(tokens))] = f"e{draw.randint(0, 30)}"
            chosen.append(" ".join(tokens))
        rows.append((doc_id, "\n".join(chosen), "en", "a", None))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(spark, rows, frame)


def test_few_counters_change_nothing(spark, documents, awkward, monkeypatch):
    monkeypatch.setattr(line_dedup, "COUNTERS", 4)
    check(spark, awkward, documents)


def test_other_columns_and_empty(clashing, documents, no_documents):
    def plain(docs):
        return rows_of(line_dedup.deduplicated(docs).select("doc_id", "text", "n_removed"))

    assert plain(clashing) == plain(documents)
    assert set(line_dedup.deduplicated(clashing).columns) > set(clashing.columns)
    assert line_dedup.deduplicated(no_documents).count() == 0


def test_plan_has_no_python(documents):
    plan = line_dedup.deduplicated(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_large_families_and_refuted_hubs(spark, monkeypatch):
    """Families with heavy words, members of which match an earlier one but not the hub."""
    import random

    monkeypatch.setattr(line_dedup, "HEAVY", 2)
    draw = random.Random(7)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(30)]
        for member in range(25):
            tokens = list(base)
            for _ in range(draw.randint(0, 9)):
                tokens[draw.randrange(len(tokens))] = f"e{draw.randint(0, 40)}"
            rows.append((family * 100 + member, " ".join(tokens), "en", "a", None))
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(spark, rows, frame)


def test_least_shared_prefix_words_never_exceed_what_matches_share():
    """Prefixes of random matching sets share at least the bound."""
    import math
    import random

    draw = random.Random(3)
    seen = 0
    for _ in range(3000):
        a = set(draw.sample(range(200), draw.randint(3, 60)))
        b = set(a)
        for _ in range(draw.randint(0, 8)):
            b.discard(draw.choice(sorted(b))) if draw.random() < 0.5 and len(b) > 1 else b.add(draw.randrange(200))
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        seen += 1
        length = {len(s): len(s) - math.ceil(0.8 * len(s) - 1e-9) + 1 for s in (a, b)}
        shared = len(set(sorted(a)[: length[len(a)]]) & set(sorted(b)[: length[len(b)]]))
        needed = math.ceil((len(a) + len(b)) * 80 / 180 - 1e-9)
        rest = max(math.ceil(0.8 * len(s) - 1e-9) for s in (a, b)) - 1
        assert shared >= max(1, needed - rest)
    assert seen > 500


def test_spaces_of_every_kind_part_words(spark):
    lines = ["a b  c", " a\tb c ", "a\x0bb\x0cc\r", "c b a", "\t \r"]
    frame = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    found = line_dedup.deduplicated(frame).first()
    assert (found["n_token_lines"], found["n_removed"], found["text"]) == (4, 3, "a b  c\n\t \r")


def test_matching_sets_share_one_of_their_first_pairs(spark):
    """Sets of every size and all ways to match; the sizes at which a pair is lost most included."""
    import random

    sizes = spark.range(200).select(line_dedup.n_pairs(F.col("id")).alias("n")).collect()
    first = [row["n"] for row in sizes]
    draw = random.Random(5)

    def pairs(words):
        words = sorted(words)
        return set(list(zip(words, words[1:]))[: first[len(words)]])

    seen = 0
    for size in range(1, 120):
        for lost in range(size // 5 + 1):
            for more in range(size // 4 + 1):
                if 5 * (size - lost) < 4 * (size + more):
                    continue
                for _ in range(3):
                    a = set(draw.sample(range(1000), size))
                    # Words lost and put in among the first of the set part the most pairs.
                    early = sorted(a)[: 3 * lost + 1]
                    b = a - set(draw.sample(early if len(early) >= lost else sorted(a), lost))
                    b |= set(draw.sample(sorted(set(range(-500, 1000)) - a), more))
                    seen += a != b
                    assert a == b or pairs(a) & pairs(b)
    assert seen > 1000


def test_a_frequent_rare_word_brings_no_candidates(spark):
    """One word that all lines have, and that leads in all, pairs none of them."""
    from pagemart.llm.common import Tables

    rows = [(i, "shared " + " ".join(f"l{i}w{j}" for j in range(20))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    levels = [1] * line_dedup.COUNTERS
    shared = spark.sql("SELECT xxhash64('shared') AS h").first()["h"]
    levels[shared & (line_dedup.COUNTERS - 1)] = 0
    with Tables(spark, "test") as tables:
        classes = tables.table(line_dedup.line_classes(line_dedup.line_sets(docs, levels)))
        twos, members = line_dedup.shared_pairs(classes, tables)
        assert classes.count() == 200
        assert (twos.count(), members.count()) == (0, 0)


def test_prefixes_part_what_parity_bits_leave_open(spark):
    """Long sets that share their first words only never have their sets made; matches do."""
    from pagemart.llm.common import Tables

    lines = ["first second " + " ".join(f"l{i}w{j}" for j in range(300)) for i in range(12)]
    lines += [lines[0].replace(f"l0w{k} ", f"e{k} ") for k in (0, 150, 298)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    levels = [1] * line_dedup.COUNTERS
    for h in spark.sql("SELECT xxhash64('first') AS a, xxhash64('second') AS b").first():
        levels[h & (line_dedup.COUNTERS - 1)] = 0
    with Tables(spark, "test") as tables:
        classes = tables.table(line_dedup.line_classes(line_dedup.line_sets(docs, levels)))
        places = classes.select("cls", F.col("first.doc_id").alias("doc"))
        a, b = places.toDF("a", "doc_a"), places.toDF("b", "doc_b")
        every = tables.table(a.join(b, F.col("doc_a") < F.col("doc_b")).select("a", "b"))
        left_open = line_dedup._open(every, classes)
        kept = line_dedup._agreeing(left_open, classes, tables).join(a, "a").join(b, "b")
        assert left_open.count() > 30
        found = {(row["doc_a"], row["doc_b"]) for row in kept.collect()}
    assert found == {(x, y) for x in (0, 12, 13, 14) for y in (0, 12, 13, 14) if x < y}


def test_prefixes_of_matching_sets_agree(spark):
    """Random matching sets of many sizes, few short numbers for many words included."""
    import random

    draw = random.Random(11)
    sizes = [row["n"] for row in spark.range(200).select(line_dedup.n_pairs(F.col("id")).alias("n")).collect()]
    rows = []
    while len(rows) < 1500:
        a = set(draw.sample(range(1000), draw.randint(4, 90)))
        b = a - set(draw.sample(sorted(a), draw.randint(0, len(a) // 5)))
        # New words early in the order leave the prefixes the least room.
        b |= set(draw.sample(range(-300, draw.choice((0, 1000))), draw.randint(0, len(a) // 4)))
        if a == b or 100 * len(a & b) < 80 * len(a | b):
            continue
        numbers = draw.choice((7, 50, 1 << 30))
        prefixes = [[w % numbers for w in sorted(x)[: sizes[len(x)] + 1]] for x in (a, b)]
        rows.append((len(a), len(b), *(len(set(p)) for p in prefixes), *prefixes))
    names = "size_a int, size_b int, own_a int, own_b int, prefix_a array<int>, prefix_b array<int>"
    frame = spark.createDataFrame(rows, names)
    assert frame.where(line_dedup.prefixes_agree()).count() == 1500


def test_texts_are_not_shuffled_for_few_lines_to_go(spark, documents):
    """The size of the files that hold the lines to go decides nothing."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = line_dedup.deduplicated(documents)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
