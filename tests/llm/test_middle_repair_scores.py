"""Fill-in-middle, conversation repair and language-model scores against brute force, round trips and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from watchloom.llm import conversation_repair as repair
from watchloom.llm import fill_in_middle as fim
from watchloom.llm import partial_matching as ppm


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in middle


def fim_brute(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{doc_id if doc_id is not None else chr(92) + 'N'}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, ("spm" if h[3] % 100 < 20 else "psm"), a, b - a, out


def test_fill_in_middle_equals_brute_force(spark, odd_docs, docs):
    marked = spark.createDataFrame([(k, t) for k in range(20, 60) for t in ("a <P> b", "x" * 70_000 + "<", "<S" * 9, "é\U0001f600" * 40_000)], "doc_id bigint, text string")
    rows = odd_docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text")).unionByName(marked)
    want = Counter()
    for r in rows.collect():
        n, form, a, m, out = fim_brute(r.doc_id, r.text)
        want[(r.doc_id, n, form, a, m, sha(out), sha(r.text or ""))] += 1
    assert Counter(map(tuple, fim.digests(rows).collect())) == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    outputs = fim.transform(rows)
    assert Counter((r.doc_id, r.form, r.output) for r in outputs.collect()) == Counter((r.doc_id, f[1], f[4]) for r in rows.collect() for f in [fim_brute(r.doc_id, r.text)])
    assert Counter((r.doc_id, r.text) for r in fim.restore(outputs).collect()) == Counter((r.doc_id, r.text or "") for r in rows.collect())


def test_fill_in_middle_repeated_rows_and_none(spark, no_docs):
    same = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("one and the same row").alias("text"))
    got = fim.digests(same).collect()
    assert len(got) == 3000 and len(set(got)) == 1 and got[0].restored_sha256 == sha("one and the same row")
    assert fim.digests(no_docs).count() == fim.transform(no_docs).count() == fim.restore(fim.transform(no_docs)).count() == 0
    broken = spark.createDataFrame([(1, "psm", "no marks here"), (2, "plain", None), (3, None, "as it is")], "doc_id bigint, form string, output string")
    assert {r.doc_id: r.text for r in fim.restore(broken).collect()} == {1: None, 2: "", 3: "as it is"}


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 1000])
def test_parser_takes_marks_across_pieces(chunk):
    for form, (a, b) in (("psm", (3, 8)), ("spm", (0, 0)), ("psm", (11, 11)), ("plain", (2, 4))):
        text = "ab<<S<P hallo"[:11]
        output = "".join(fim.cut(text, form, a, b, chunk=4))
        parser = fim.Parser(form)
        parts = [p for at in range(0, len(output), chunk) for p in parser.feed(output[at : at + chunk])] + list(parser.rest())
        assert "".join(t for _, t in sorted(parts, key=lambda p: p[0])) == text and parser.whole


# ---- conversation repair


def repair_brute(rows):
    """rows: (role, text) in order. (blank, duplicate, truncated, illegal, cost, audit, repaired) by trying all edits."""
    seen, faults = set(), []
    for role, text in rows:
        if not text.strip(" \t\n\x0b\x0c\r"):
            faults.append("b")
        elif (role, text) in seen:
            faults.append("d")
        else:
            faults.append("" if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else "t")
        seen.add((role, text))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    grown = lambda state, x: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "ua", ("ua", "u"): "u"}.get((state, x))
    rest = dict.fromkeys(("", "s", "u", "ua"), (10**9, "", ()))

    def inserted(rest):  # two insertions in a row are all that can be of use
        for _ in range(3):
            for state in rest:
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (to := grown(state, x)) is not None:
                        cost, audit, out = rest[to]
                        rest[state] = min(rest[state], (cost + 3, "I" + audit, ((name, ""), *out)))
        return rest

    rest[""] = rest["ua"] = (0, "", ())
    rest = inserted(rest)
    for (role, text), fault in reversed(list(zip(rows, faults))):
        now = {}
        for state in rest:
            cost, audit, out = rest[state]
            found = [(cost + 4, "D" + audit, out)]
            for edit, x, name, price in (("K", role[:1], role, 0), ("R", "u", "user", 3), ("R", "a", "assistant", 3)):
                to = grown(state, x)
                if fault not in ("b", "d") and to is not None:
                    cost, audit, out = rest[to]
                    found.append((cost + price + 3 * (fault == "t"), edit + audit, ((name, text), *out)))
            now[state] = min(found)
        rest = inserted(now)
    cost, audit, out = rest[""]
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def damaged_brute(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def report_brute(rows):
    want = set()
    after = damaged_brute(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        *counts, audit, text = repair_brute([r[2:] for r in own])
        want.add((conv, gaps, *counts, audit, sha(text)))
    return want


def odd_conversations():
    rng, rows = random.Random(5), []
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Anna", "sam"], ["Hi.", "so", "", " ", None, "Well!\n", "what? ", "é. ", "a" * 9000 + "."]
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts)))
    rows += [(100, t, ("user", "assistant")[t % 2], f"row {t // 3}.") for t in range(900)]
    return rows


def test_repair_equals_brute_force(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("copies", F.lit("clash")).withColumn("at", F.lit(1))
    got = repair.repair_report(repair.damage(df), copies_col="copies").collect()
    assert {tuple(r) for r in got} == report_brute(rows) and len(got) == len({r[0] for r in rows})


def test_repaired_rows_follow_the_audit(spark):
    rows = [r for r in odd_conversations() if r[0] != 100]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place)):
        out.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    for r in repair.repair_report(df).collect():
        mine = out.get(r.conv_id, [])
        assert [x[0] for x in mine] == [x for x in r.audit if x != "D"]
        assert sha("\n".join(f"{a}:{b}" for _, a, b in mine)) == r.repaired_sha256
        initials = "".join(a[0] for _, a, _ in mine)
        assert initials in ("", "s" * initials.startswith("s") + "ua" * (len(initials) // 2))


def test_block_tables_are_the_step_rule():
    table, rng = repair.tables(), random.Random(3)
    assert len(table.vectors) < 200
    for _ in range(500):
        behind, block = rng.randrange(len(table.vectors)), tuple(rng.randrange(repair.SYMBOLS) for _ in range(rng.randrange(1, repair.WIDTH + 1)))
        vector = table.vectors[behind]
        for symbol in reversed(block):
            vector = repair.step(vector, symbol)
        at = repair.code(block)
        before, more = table.vectors[table.before[len(block)][behind, at]], table.adds[len(block)][behind, at]
        assert tuple(x + more for x in before) == vector


def test_a_conversation_over_many_chunks(spark):
    n = 3 * repair.CHUNK + 5
    df = spark.range(n).select(F.lit("c").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") % 2 + 1).cast("int")).alias("role"), F.concat(F.lit("No. "), "id", F.lit(".")).alias("text"))
    row = repair.repair_report(df).first()
    assert row.conv_id == "c" and row.audit == "K" * n + "I" and row.cost == 3 and row.illegal == 0
    text = "\n".join(f"{('user', 'assistant')[k % 2]}:No. {k}." for k in range(n)) + "\nassistant:"
    assert row.repaired_sha256 == sha(text)
    assert repair.repair_report(df.limit(0)).count() == 0
    same = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.lit(None).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    row = repair.repair_report(same).first()
    assert (row.gaps, row.duplicate, row.cost, row.audit) == (0, 19_999, 4 * 19_999 + 3, "K" + "D" * 19_999 + "I")


# ---- language-model scores


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def ppm_brute(train, text, order=ppm.ORDER):
    """Contexts in a dictionary; exclusion by sets of symbols."""
    row, out = [256] * order + list(lowered(text)) + [256], 0.0
    for at in range(order, len(row)):
        gone, left = set(), True
        for k in range(order, -1, -1):
            node = {s: n for s, n in train.get(tuple(row[at - k : at]), {}).items() if s not in gone}
            if not node:
                continue
            whole = sum(node.values()) + len(node)
            if row[at] in node:
                out += math.log10(node[row[at]] / whole)
                left = False
                break
            out += math.log10(len(node) / whole)
            gone |= set(node)
        if left:
            out -= math.log10(257 - len(gone))
    return out


def learnt(texts, order=ppm.ORDER):
    train = {}
    for text in texts:
        row = [256] * order + list(lowered(text)) + [256]
        for at in range(order, len(row)):
            for k in range(order + 1):
                train.setdefault(tuple(row[at - k : at]), Counter())[row[at]] += 1
    return train


def score_brute(rows):
    learns = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    train, counts = learnt(learns), Counter()
    for t in learns:
        counts.update([*lowered(t).split(), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = [*lowered(t).split(), b""]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), n, base, ppm_brute(train, t)))
    return out


def same_scores(got, want):
    rounded = lambda rows: Counter((*r[:5], f"{r[5]:.8g}", f"{r[6]:.8g}") for r in rows)
    return rounded(got) == rounded(want)


def test_scores_equal_brute_force(spark, docs, odd_docs):
    some = docs.orderBy(F.length("text"), "doc_id").limit(120).select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text").filter("length(text) < 100000 or text is null"))
    rows = [tuple(r) for r in some.collect()]
    some = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("block", F.lit("clash")).repartition(3)
    assert same_scores([tuple(r) for r in ppm.score(some).collect()], score_brute(rows))


def test_scores_do_not_depend_on_blocks(spark, docs, monkeypatch):
    rows = docs.select("doc_id", "text")
    whole = [tuple(r) for r in ppm.score(rows).collect()]
    monkeypatch.setattr(ppm, "BLOCK", 3000)
    assert same_scores([tuple(r) for r in ppm.score(rows).collect()], whole)


def test_scores_of_long_texts_nothing_learnt_and_none(spark, odd_docs, no_docs, monkeypatch):
    data = b"abc" * 50_000
    whole = [x for part in ppm.grams(data) for x in part.tolist()]
    monkeypatch.setattr(ppm, "SLICE", 777)
    assert [x for part in ppm.grams(data) for x in part.tolist()] == whole and len(whole) == len(data) + 1
    assert [x for part in ppm.grams(b"") for x in part.tolist()] == [int("100000000" * 5, 2)]
    assert ppm.score(no_docs).count() == 0
    nothing = {r.doc_id: r for r in ppm.score(odd_docs.filter("doc_id <= 3 or doc_id is null"), held=F.lit(True)).collect()}
    assert nothing[1].base_score == 0 and nothing[1].train_tokens == 0 and nothing[1].n_tokens == 1 and math.isclose(nothing[1].score, -math.log10(257))
    assert math.isclose(nothing[3].score, -15 * math.log10(257)) and nothing[3].held_out
    assert ppm.score(odd_docs).count() == odd_docs.count()


def test_probabilities_come_to_one():
    train = learnt(["abracadabra", "banana", "", "abba"])
    for context in (b"", b"a", b"br", b"xyz", b"abra"):
        have = [256] * ppm.ORDER + list(context)
        whole = 0.0
        for symbol in range(257):
            row, gone, p = have[-ppm.ORDER :], set(), 1.0
            for k in range(ppm.ORDER, -1, -1):
                node = {s: n for s, n in train.get(tuple(row[ppm.ORDER - k :]), {}).items() if s not in gone}
                if node and symbol in node:
                    p *= node[symbol] / (sum(node.values()) + len(node))
                    break
                if node:
                    p *= len(node) / (sum(node.values()) + len(node))
                    gone |= set(node)
            else:
                p /= 257 - len(gone)
            whole += p
        assert math.isclose(whole, 1)


def test_training_helps_and_adaptive_scores(spark, docs):
    scores = ppm.score(docs).filter("held_out").collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(scores) > 5 and sum(r.score for r in scores) / sum(len(text[r.doc_id].encode()) for r in scores) > -0.75
    train: dict = {}
    row, out = [256] * 4 + list(b"mississippi river") + [256], 0.0
    for at in range(4, len(row)):
        one = ppm_brute_symbol(train, row, at)
        out += one
        for k in range(5):
            train.setdefault(tuple(row[at - k : at]), Counter())[row[at]] += 1
    assert math.isclose(ppm.adaptive_score("Mississippi River"), out)
    got = {r.doc_id: r.score for r in ppm.adaptive(spark.createDataFrame([(1, None), (2, "ab")], "doc_id bigint, text string")).collect()}
    assert math.isclose(got[1], -math.log10(257)) and got[2] < got[1]


def ppm_brute_symbol(train, row, at):
    gone, out = set(), 0.0
    for k in range(4, -1, -1):
        node = {s: n for s, n in train.get(tuple(row[at - k : at]), {}).items() if s not in gone}
        if node and row[at] in node:
            return out + math.log10(node[row[at]] / (sum(node.values()) + len(node)))
        if node:
            out += math.log10(len(node) / (sum(node.values()) + len(node)))
            gone |= set(node)
    return out - math.log10(257 - len(gone))
