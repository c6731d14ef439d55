import hashlib
import math
import re
import warnings
from collections import Counter, defaultdict

import cases
import duckdb
import pyarrow as pa
import pytest

from tracewright.llm import chat_rotation, line_frequency, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def normalised(line):
    up = {chr(c): chr(c + 32) for c in range(65, 91)} | {str(d): "0" for d in range(10)}
    return re.sub(r"[\x20\x09-\x0D]+", " ", "".join(up.get(c, c) for c in line)).strip(" ")


def lines_by_hand(rows, min_docs, share, max_docs):
    held, hosts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        hosts[s].add(t or "")
        for x in (t or "").split("\n"):
            if WORD.search(x):
                held[s, normalised(x)].add(t)
    frequent = {k for k, texts in held.items() if len(texts) > max(min_docs, min(max_docs, math.ceil(share * len(hosts[k[0]]))))}
    for i, t, s in rows:
        kept = [x for x in (t or "").split("\n") if (s, normalised(x)) not in frequent or not WORD.search(x)]
        yield i, "\n".join(kept), len(WORD.findall("\n".join(kept)))


def test_base_figures_and_hard_rows(spark):
    got = line_frequency.remove_frequent_lines(cases.hard(spark)).collect()
    want = Counter((r[0], *base_by_hand(r[1])) for r in cases.hard_rows())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert line_frequency.remove_frequent_lines(cases.empty(spark)).count() == 0


def test_frequent_lines_leave_their_host_only(spark):
    footer, rows = "All rights reserved 2023", []
    for i in range(40):
        body = cases.prose(i, 30)
        rows.append((i, f"{body}\n{footer.upper() if i % 2 else footer} \n" + ("tail line" if i < 12 else ""), "a" if i < 30 else "b"))
    rows += [(900 + i, f"{footer}\n{footer}\nwords " + cases.prose(i, 2), "a") for i in range(5)]
    rows += [(950, rows[0][1], "a"), (0, rows[0][1], "a")]
    rows += [(960 + i, cases.prose(9000, 40), "a") for i in range(30)]  # copies of one text make no line frequent
    got = line_frequency.remove_frequent_lines(cases.docs(spark, rows), min_docs=10, share=0.1).collect()
    assert Counter((r["doc_id"], r["clean_text"], r["words_left"]) for r in got) == Counter(lines_by_hand(rows, 10, 0.1, 100))
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[900 + i] for i in range(5)) and all(kept[i] for i in range(40)) and all(kept[960 + i] for i in range(30))


def test_the_limit_does_not_grow_with_a_large_host(spark):
    """A line in 15 of 200 documents is under a tenth of them, but over `max_docs`."""
    rows = [(i, cases.prose(i, 12) + ("\nread more here" if i < 15 else ""), "a") for i in range(200)]
    docs = cases.docs(spark, rows)
    for most, gone in ((100, 0), (12, 15)):
        got = line_frequency.remove_frequent_lines(docs, max_docs=most).collect()
        assert Counter((r["doc_id"], r["clean_text"], r["words_left"]) for r in got) == Counter(lines_by_hand(rows, 10, 0.1, most))
        assert sum(r["words_left"] < r["n_words"] for r in got) == gone


def test_poisson_table():
    t = mixing.poisson_table(2.5)
    assert abs(t[0] - math.exp(-2.5)) < 1e-15 and abs(t[-1] - 1) < 1e-12 and all(a <= b for a, b in zip(t, t[1:], strict=False))
    assert abs(sum(1 - c for c in t) - 2.5) < 1e-9  # the mean
    assert mixing.poisson_table(0.0) == [1.0]


def test_mixing_reaches_its_weights(spark):
    rows = [(i, cases.prose(i, 3), "big" if i % 10 else "small") for i in range(6000)]
    docs = cases.docs(spark, rows)
    got = mixing.mix_sources(docs, {"big": 0.5, "small": 0.5}).collect()
    n = Counter(r["source"] for r in got)
    assert abs(n["big"] - 3000) < 200 and abs(n["small"] - 3000) < 350
    times = Counter(r["doc_id"] for r in got)
    assert all({r["copy"] for r in got if r["doc_id"] == i} == set(range(1, times[i] + 1)) for i in list(times)[:50])
    again = mixing.mix_sources(docs.repartition(7), {"big": 0.5, "small": 0.5}).collect()
    assert Counter(got) == Counter(again)


def test_mixing_hard_rows(spark):
    docs = cases.hard(spark)
    got = mixing.mix_sources(docs, {"a": 1.0, "hot": 2.0, mixing.OTHER: 3.0})
    assert set(got.columns) == set(docs.columns)
    assert len(set(Counter(r["copy"] for r in got.filter("doc_id = 20").collect()).values())) <= 1  # equal rows, equal counts
    assert mixing.mix_sources(cases.empty(spark), {"a": 1.0}).count() == 0


def drawn_by_hand(i, mean):
    parts = max(1, math.ceil(mean / mixing.PART_RATE))
    table = mixing.poisson_table(mean / parts)
    uniform = lambda p: int(hashlib.md5(f"{mixing.SEED}|{i}{f'|{p}' if p else ''}".encode()).hexdigest()[:13], 16) / 2**52
    return sum(c <= uniform(p) for p in range(parts) for c in table)


def test_rare_sources_reach_their_weight(spark, monkeypatch):
    """10 rows of 2,000 at half the weight: a rate of 100, drawn in parts, as DuckDB and a plain version draw it."""
    monkeypatch.setattr(mixing, "WEIGHTS", {"rare": 0.5, "big": 0.5})
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(i, f"text {i}", "rare" if i < 10 else "big") for i in range(2000)]
    docs = cases.docs(spark, rows)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = Counter((r["doc_id"], r["copy"]) for r in mixing.mix_sources(docs, mixing.WEIGHTS).collect())
    times = Counter(i for i, _ in got)
    assert got == Counter((i, c + 1) for i, n in times.items() for c in range(n))
    assert times == +Counter({i: drawn_by_hand(i, 100.0 if i < 10 else 1000 / 1990) for i, _, _ in rows})
    assert abs(sum(times[i] for i in range(10)) - 1000) < 100
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]})  # noqa: F841
    assert Counter(duckdb.sql(mixing.mixing_sql("documents", "doc_id")).fetchall()) == got


def test_poisson_parts_keep_mean_and_variance():
    mean = 5000.0
    drawn = [drawn_by_hand(i, mean) for i in range(60)]
    assert abs(sum(drawn) / 60 - mean) < 5 * math.sqrt(mean / 60) and 0.4 * mean < sum((d - mean) ** 2 for d in drawn) / 60 < 2 * mean


def test_mixing_tells_the_weights_it_misses(spark):
    docs = cases.docs(spark, [(i, f"text {i}", "rare" if i < 8 else "big") for i in range(1000)])
    with pytest.warns(UserWarning, match=r"rare: 0\.5000 wanted, 0\.2038 reached"):  # 8 x 16 of 8 x 16 + 500
        got = mixing.mix_sources(docs, {"big": 0.5, "rare": 0.5}, max_rate=16.0)
    assert abs(got.filter("source = 'rare'").count() / got.count() - 0.2038) < 0.05
    with pytest.warns(UserWarning, match="gone: 0.5000 wanted, 0.0000 reached"):
        mixing.mix_sources(docs, {"gone": 0.5, mixing.OTHER: 0.5})
    counts = {"big": 992, "rare": 8}
    assert mixing.weights_reached(counts, {"big": 0.5, "rare": 16.0}, {"big": 1.0, "rare": 1.0}) == {"big": (0.5, 496 / 624), "rare": (0.5, 128 / 624)}
    for wrong in ({"a": 0.0}, {}, {"a": -1.0, "b": 2.0}, {"a": math.inf}):
        with pytest.raises(ValueError, match="weights"):
            mixing.mix_sources(docs, wrong)


def test_a_thousand_weights(spark):
    docs = cases.docs(spark, [(i, f"text {i}", f"s{i % 1000}") for i in range(3000)])
    n = mixing.mix_sources(docs, {f"s{i}": 1.0 for i in range(1000)}).count()
    assert abs(n - 3000) < 300


def test_mixing_stage_keeps_clashing_columns(spark):
    docs = cases.hard(spark)
    got = mixing.stage(spark, docs, "")
    assert got.columns == docs.columns and {r["copy"] for r in got.collect()} == {7}
    assert mixing.stage(spark, cases.empty(spark), "").count() == 0


def chat_by_hand(rows, part_turns=None):
    talks = defaultdict(list)
    for i, (c, t, role, text) in enumerate(rows):
        talks[c, i if c is None else None].append((t, role or "unknown", text or ""))
    esc = lambda s: s.replace("<|", "< |")
    for (c, _), said in talks.items():
        parts = defaultdict(list)
        for m in said:
            parts[0 if part_turns is None else -1 if m[0] is None else m[0] // part_turns].append(m)
        for p, ms in parts.items():
            for me in {r for _, r, _ in ms} - {"system"}:
                out, spans = "", []
                for t, role, text in sorted(ms, key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2])):
                    out += "<|assistant|>\n" if role == me else "<|system|>\n" if role == "system" else f"<|user:{esc(role)}|>\n"
                    start = len(out)
                    out += esc(text) + "<|end|>\n"
                    spans += [(start, len(out) - 1)] if role == me else []
                yield c, me, p, len(ms), out, tuple(spans)


@pytest.mark.parametrize("part_turns", [None, 128])
def test_every_speaker_gets_a_view(spark, part_turns):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "\U0001F600 yo"), (1, 3, "ann", None), (1, 3, "ann", None), (1, None, None, "?"), (2, 0, "system", "alone"), (None, 5, "x<|", "null id"), (None, 5, "x<|", "null id"), (None, 6, "y", "another")]
    rows += [(3, t, "ann" if t % 2 else "bob", f"turn {t}") for t in range(1000)] + [(3, 1000, "<|late|>", "one")]
    table = spark.createDataFrame([(*r, "clash", 1, "h", 0) for r in rows], "conv_id long, turn long, role string, text string, perspective string, part int, head string, at int")
    got = chat_rotation.rotate(table, part_turns=part_turns).collect()
    assert Counter((r["conv_id"], r["perspective"], r["part"], r["n_messages"], r["text"], tuple((m["start"], m["end"]) for m in r["mask"])) for r in got) == Counter(chat_by_hand(rows, part_turns))
    assert all(r["mask"] for r in got)
    assert chat_rotation.rotate(table.limit(0)).count() == 0


def test_many_equal_turns_are_cut_on_request(spark):
    table = spark.createDataFrame([(1, 0, "a", f"m{i}") for i in range(10)], "conv_id long, turn long, role string, text string")
    assert sorted(r["n_messages"] for r in chat_rotation.rotate(table, part_rows=4).collect()) == [2, 4, 4]
    assert [r["n_messages"] for r in chat_rotation.rotate(table).collect()] == [10]
