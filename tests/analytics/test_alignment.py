"""Edit scripts against a plain dynamic programme, corrections with their times, dictionary corrections."""

import random

import pytest

from spindrift.operators.alignment import Dictionary, WORDS, acceptable, apply_corrections, correct_words, kept_pairs, letters, realigned


def w(text, s, e, p=0.9):
    return {"w": text, "s": s, "e": e, "p": p}


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1]


def test_scripts_are_as_short_as_can_be():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.choice("abcd") for _ in range(rng.randrange(14))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(14))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        kept = kept_pairs(a, b)
        assert len(kept) == longest(a, b)
        assert all(a[i] == b[j] for i, j in kept)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(kept, kept[1:]))


def test_times_never_fall_and_kept_words_keep_theirs():
    rng = random.Random(2)
    for _ in range(1500):
        n, t, words = rng.randrange(1, 12), 0.0, []
        for _ in range(n):
            t += rng.random() * 0.3
            words.append(w(rng.choice(["on", "the", "ball", "now", "pass"]), round(t, 2), round(t + 0.2, 2), rng.random()))
            t += 0.25
        fresh = [rng.choice(["on", "the", "ball", "then", "go", "!"]) for _ in range(rng.randrange(1, 14))]
        out = realigned(words, " ".join(fresh))
        assert [x["w"] for x in out] == fresh
        assert all(x["s"] <= x["e"] + 1e-9 for x in out) and all(x["e"] <= y["s"] + 0.011 for x, y in zip(out, out[1:]))
        assert words[0]["s"] <= out[0]["s"] and out[-1]["e"] <= words[-1]["e"] + 1e-9
        kept = kept_pairs([letters(x["w"]) for x in words], [letters(x) for x in fresh])
        same = sum((out[j]["s"], out[j]["e"]) == (words[i]["s"], words[i]["e"]) for i, j in kept)
        inserted = len(fresh) - len(kept)
        assert same >= len(kept) - 2 * inserted  # an insertion takes from one neighbour


def test_cases():
    out = realigned([w("왜", 8.5, 8.7), w("다들", 8.7, 9.0), w("공으로", 9.9, 10.4), w("칠까요?", 10.4, 11.1)], "왜 다들 공을 놓칠까요?")
    assert (out[0]["s"], out[1]["e"], out[2]["s"], out[3]["e"]) == (8.5, 9.0, 9.9, 11.1) and out[2]["e"] < out[3]["e"]
    out = realigned([w("골", 1.0, 1.3), w("때", 1.3, 1.5, 0.4), w("맞았어요.", 1.5, 2.0)], "골대 맞았어요.")
    assert [(x["w"], x["s"], x["e"], x["p"]) for x in out] == [("골대", 1.0, 1.5, 0.4), ("맞았어요.", 1.5, 2.0, 0.9)]
    assert [x["w"] for x in realigned([w("a", 1.0, 1.3), w("b", 1.3, 1.8)], "a then b")] == ["a", "then", "b"]
    assert [(x["w"], x["s"]) for x in realigned([w("uh...", 7.1, 7.6), w("why", 8.5, 8.7)], "why")] == [("why", 8.5)]
    assert [x["w"] for x in realigned([w("x", 0.0, 1.0)], "a x b")] == ["a", "x", "b"]
    assert realigned([], "a") == [] and realigned([w("a", 0, 1)], " ") == []
    assert acceptable("the ball is there", "the ball was there") and acceptable("three of them", "three of them.")
    assert not acceptable("one two three", "what fine weather we have today") and not acceptable("same", "same") and not acceptable(None, "a")


def test_dictionary_cases():
    book = Dictionary({"피버": "피벗", "풋살 사관학교": "풋살사관학교", "퍼스트터치": "퍼스트 터치"})
    want = {"피버": "피벗", "피버, 픽소": "피벗, 픽소", "(피버)": "(피벗)", "피버를 보고": "피벗을 보고", "피버가 내려와요": "피벗이 내려와요", "피버로": "피벗으로", "피버에서도": "피벗에서도", "피버트": "피버트", "풋살피버": "풋살피버", "피버링": "피버링", "오늘 풋살 사관학교 영상": "오늘 풋살사관학교 영상", "퍼스트터치를": "퍼스트 터치를", "": ""}
    assert {k: book.text(k) for k in want} == want
    out = book.words([w("오늘", 0.0, 0.3), w("풋살", 0.4, 0.7, 0.6), w("사관학교", 0.75, 1.3, 0.8), w("퍼스트터치를", 1.4, 2.0), w("피버로", 2.1, 2.5)])
    assert [x["w"] for x in out] == ["오늘", "풋살사관학교", "퍼스트", "터치를", "피벗으로"]
    assert (out[1]["s"], out[1]["e"], out[1]["p"], out[2]["s"], out[3]["e"]) == (0.4, 1.3, 0.6, 1.4, 2.0)
    assert Dictionary({}).text("a") == "a"


def test_in_spark(spark):
    rows = [(1, "골 때 맞았어요.", [w("골", 1.0, 1.3), w("때", 1.3, 1.5), w("맞았어요.", 1.5, 2.0)]), (2, "one two three", [w("one", 0.0, 1.0)]), (3, None, None), (4, "the bal", [])]
    segments = spark.createDataFrame(rows, f"seg long, text string, words {WORDS}")
    fixes = spark.createDataFrame([(1, "골대 맞았어요."), (2, "what fine weather it is"), (4, "the ball"), (9, "x")], "seg long, fixed string")
    got = {r.seg: r for r in apply_corrections(segments, fixes, ["seg"]).collect()}
    assert [r.w for r in got[1].words] == ["골대", "맞았어요."] and got[1].text == "골대 맞았어요." and got[1].corrected
    assert not got[2].corrected and got[2].text == "one two three" and got[3].words is None and not got[3].corrected
    assert got[4].corrected and got[4].text == "the ball" and got[4].words == []
    book = spark.createDataFrame([("때", "대"), (None, "x"), ("bal", "ball")], "wrong string, right string")
    got = {r.seg: r for r in correct_words(segments, book).collect()}
    assert [r.w for r in got[1].words] == ["골", "대", "맞았어요."] and got[1].fixes == 1 and got[4].text == "the ball" and got[3].fixes == 0
    with pytest.raises(ValueError):
        correct_words(segments, book, most=1)
    assert apply_corrections(segments.limit(0), fixes, ["seg"]).count() == 0


def test_queries_equal_the_rules_row_by_row(spark):
    from spindrift.plans import speech_plans
    from spindrift.plans.catalogue import QUERIES

    home = "/root/testdata/sf0.001"
    lines = {(r.key, r.seg): [x.asDict() for x in r.words] for r in speech_plans._timed_lines(spark, home).collect()}
    got = {}
    for r in QUERIES["j23_corrected_times"](spark, home).orderBy("key", "seg", "place").collect():
        got.setdefault((r.key, r.seg), []).append(r)
    assert len(got) == len(lines) > 10 and sum(v[0].corrected for v in got.values()) > 0.8 * len(lines)
    for k, words in lines.items():
        edited = ["" if i % 7 == 6 else x["w"] + "s" if i % 5 == 4 else "so " + x["w"] if i % 11 == 10 else x["w"] for i, x in enumerate(words)]
        fixed = " ".join(x for x in edited if x)
        want = realigned(words, fixed) if acceptable(" ".join(x["w"] for x in words), fixed) else words
        assert [(r.w, r.s, r.e, r.p) for r in got[k]] == [(x["w"], x["s"], x["e"], x["p"]) for x in want]
    book = Dictionary(speech_plans._DICTIONARY)
    fixed = {}
    for r in QUERIES["f6_dictionary_words"](spark, home).orderBy("key", "seg", "place").collect():
        fixed.setdefault((r.key, r.seg), []).append((r.w, r.s, r.e))
    assert fixed == {k: [(x["w"], x["s"], x["e"]) for x in book.words(words)] for k, words in lines.items()}
