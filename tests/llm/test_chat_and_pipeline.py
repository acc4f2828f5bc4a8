import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import chat, decontam, line_dedup, packing, simhash

SF = "/root/testdata/sf0.001"


def brute_viterbi(lines):
    """All paths of a short sequence."""
    best = {chat.BEFORE: (0.0, [])}
    for x in lines:
        m = chat.step(chat.emission(x))
        best = {s: max(((score + m[p, s], [*path, s]) for p, (score, path) in best.items()), key=lambda t: t[0]) for s in range(chat.STATES)}
    return max(best.values(), key=lambda t: t[0])[1]


LINES = ["User: hello there", "how are you?", "", "Assistant: fine", "thanks", "### Human: what is it?", "[bot] an answer", "You are a helpful model.", "**AI**: yes", "the user: said so"]


def test_viterbi_is_the_best_path():
    random.seed(5)
    for _ in range(60):
        lines = random.choices(LINES, k=random.randint(0, 9))
        assert chat.viterbi(lines) == (brute_viterbi(lines) if lines else [])


@pytest.mark.parametrize(("line", "role"), [("User: a", 1), ("assistant: b", 2), ("### Human:", 1), ("**Bot**: x", 2), ("[system] y", 0), ("<|im_start|>user|> z", 1), ("<|assistant|>", 2), ("Q: why", 1), ("usera: b", None), ("I asked the user: b", None)])
def test_markers(line, role):
    found = chat.MARKER.match(line)
    assert (chat._ROLE_OF[found["name"].lower()] if found else None) == role


def test_chunks_give_the_whole_path(spark):
    random.seed(6)
    rows = [(f"k{c}", p, 0, random.choice(LINES)) for c, n in enumerate([0, 1, 2, 7, 40, 150]) for p in range(n)]
    lines = spark.createDataFrame(rows, "conv string, place long, idx int, line string")
    want = []
    for c in {r[0] for r in rows}:
        own = [r[3] for r in sorted(r for r in rows if r[0] == c)]
        states = chat.viterbi(own)
        starts = [i for i, s in enumerate(states) if s % 2 == 0]
        want += [(c, t, chat.ROLES[states[a] // 2], b - a) for t, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True))]
    for chunk, fan in ((1, 2), (3, 2), (4, 64), (256, 64)):
        found = [(r.conv, r.turn, r.role, r.n_lines) for r in chat.parse_lines(lines, chunk, fan).collect()]
        assert sorted(found) == sorted(want)


def test_export_round_trip(spark):
    """What an export of the table says is recovered whole: roles, texts and turns."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    found = chat.format_chats(chat.export_lines(turns)).collect()
    want = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(str(r.conv_id), []).append((r.role, r.text))
    got = {}
    for r in sorted(found, key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == want
    for conv, own in got.items():
        rendered = "".join(r.rendered for r in sorted((r for r in found if r.conv_id == conv), key=lambda r: r.turn))
        assert chat.read_back(rendered) == own


def test_roles_without_all_markers(spark):
    """Held out: a tenth of the markers is withheld, and the role must come from the model."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hidden = turns.withColumn("role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) > 0, F.col("role")))
    truth = {(f"k{r.conv_id}", r.turn): r.role for r in turns.collect()}
    lines = {}
    for r in chat.export_lines(hidden).collect():
        lines.setdefault(r.conv, []).append((r.place, r.idx, r.line))
    right = total = 0
    for conv, own in lines.items():
        own.sort()
        for (place, _, _), s in zip(own, chat.viterbi([x[2] for x in own]), strict=True):
            total += 1
            right += truth[conv, place] == chat.ROLES[s // 2]
    assert right / total > 0.88


def test_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "no marker"), (1, None, "system", "before all"), (None, 5, "assistant", "x <|user|> \\ <\\|"), (2, 3, "wizard", "unknown role"), (2, 3, "user", ""), (1, 10**12, "user", "far\naway"), (3, 0, "user", "y\n" * 20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "place", "idx", "line")})
    found = chat.format_chats(chat.export_lines(turns)).collect()
    assert [(r.role, r.text) for r in sorted(found, key=lambda r: r.turn) if r.conv_id == "1"][0] == ("system", "before all")
    alone = [r for r in found if r.conv_id is None]
    assert [(r.role, r.text) for r in alone] == [("assistant", "x <|user|> \\ <\\|")]
    assert chat.read_back(alone[0].rendered) == [("assistant", "x <|user|> \\ <\\|")]
    assert next(r for r in found if r.conv_id == "3").text == "y\n" * 20_000
    assert chat.format_chats(chat.export_lines(turns.limit(0))).count() == 0


def test_raw_transcripts(spark):
    text = "System: be kind\nHuman: hi, can you help?\nplease\nAI: yes\n\nHuman: thanks"
    rows = chat.format_chats(chat.transcript_lines(spark.createDataFrame([("a", text), ("b", None)], "id string, t string"), "id", "t")).collect()
    got = [(r.role, r.text) for r in sorted(rows, key=lambda r: r.turn) if r.conv_id == "a"]
    assert got == [("system", "be kind"), ("user", "hi, can you help?\nplease"), ("assistant", "yes\n"), ("user", "thanks")]
    assert [r.text for r in rows if r.conv_id == "b"] == [""]


# --- pipeline -----------------------------------------------------------------------------------------------


def five_word_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_confirmed_duplicates(spark):
    words = [f"w{i}" for i in range(200)]
    near = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    rows = [(5, near()), (6, near(50)), (7, near()), (8, near(*range(0, 200, 3))), (9, None), (10, ""), (11, "other words entirely"), (None, near()), (7, near())]
    found = simhash.confirmed_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1)))
    assert {r.doc_id for r in found.collect()} == {6, 7, 10}
    assert simhash.confirmed_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stages_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        after = stage(spark, docs, "/root/testdata/sf0.01")
        if k < 4:
            assert after.columns == names and dict(after.dtypes) == dict(docs.dtypes)
        after = after.persist()
        rows = after.collect()
        if k == 0:
            kept = {r.doc_id for r in rows}
            clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
            assert sum(i in kept for i in clean) / len(clean) > 0.98
            dirty = [i for i, r in labels.items() if r.quality == 0 or r.toxic == 1]
            assert sum(i in kept for i in dirty) / len(dirty) < 0.15
        elif k == 1:
            import duckdb

            con = duckdb.connect()
            con.register("documents", docs.toPandas())
            want = {i: h for i, _, _, h in con.sql(line_dedup.SQL).fetchall()}
            import hashlib

            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rows}.items() <= want.items()
            # only documents that lost all their text are gone
            assert {want[i] for i in {r.doc_id for r in before} - {r.doc_id for r in rows}} <= {hashlib.sha256(x).hexdigest() for x in (b"", b"\n", b" ")}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif k == 2:
            fps = {r.doc_id: simhash.fingerprint(r.text) for r in before}
            sets = {r.doc_id: five_word_shingles(r.text) for r in before}
            kept = {r.doc_id for r in rows}
            alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            # each document that went near-duplicates an earlier one that stayed, and no such pair is left
            assert all(any(alike(i, j) for j in kept if j < i) for i in fps if i not in kept)
            ids = sorted(kept)
            assert not any(bin(fps[a] ^ fps[b]).count("1") <= 8 and alike(a, b) for n, a in enumerate(ids) for b in ids[:n])
            # by brute force over all pairs, few are missed
            missed = sum(alike(a, b) for n, a in enumerate(ids) for b in ids[:n])
            assert len(kept) < len(fps) and missed <= 0.1 * (len(fps) - len(kept))
        elif k == 3:
            leaked = {r.doc_id for r in decontam.leaks(docs, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).collect()}
            assert {r.doc_id for r in rows} == {r.doc_id for r in before} - leaked and leaked
        else:
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
            assert all(r.offset + r.length <= packing.CAPACITY for r in rows)
        docs = after


def test_run_is_the_stages(spark):
    found = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
    assert found == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect()}
