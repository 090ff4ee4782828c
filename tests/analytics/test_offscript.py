"""Talk beside the script, against a plain walk through each recording."""

import random
import re

from spindrift.operators.offscript import Script, off_script

SAYS = Script(opening="hello|today", preroll="rec|mic", ready=r"^ready\W*\?$", polite=r"please\W*$", reply=r"(?i)^(?:yes|ok)(?: ok)*$", closing="bye|thank", cut=r"^cut(?:\W|$)", after_cut="stop it", thanks="good work", cta="subscribe", cta_goes_on="^click", channel="dm|mail", request="write|send", told="wrote", ask="write", promo_goes_on="seats", keywords=("goal",))


def plain(rows, dur):
    """(start, end, text) of one recording, by the rule."""
    rows = sorted(r for r in rows if re.sub(r"[\s.,!?~…]+", "", r[2] or ""))
    if not rows:
        return []
    has = lambda rx, t: bool(re.search(rx, t))
    bare = lambda t: re.sub(r"[\s.,!?~…]+", "", t)
    reply = lambda t: has(SAYS.reply, re.sub("[.,!?~…]+", "", t).strip())
    promo = lambda t: not (has(SAYS.told, t) and not has(SAYS.ask, t)) and has(SAYS.channel, t) and has(SAYS.request, t)
    strong = lambda t: has(SAYS.cut, t) or has(SAYS.after_cut, t)
    weak = lambda t: has(SAYS.thanks, t)
    out, k, hit, n = [], 0, False, len(rows)
    while k < n and rows[k][0] < 90:
        t = rows[k][2]
        if has(SAYS.opening, t) or "goal" in t:
            break
        if (has(SAYS.preroll, t) and (len(bare(t)) <= 16 or t.rstrip().endswith("?"))) or (has(SAYS.ready, t) and (not has(SAYS.polite, t) or (k + 1 < n and reply(rows[k + 1][2])))):
            hit = True
        elif not reply(t):
            break
        k += 1
    begin = 0
    if hit and 0 < k < n:
        begin = k
        out.append((0.0, round(min(rows[k][0], rows[k - 1][1] + 0.3), 2), "pre", " ".join(r[2] for r in rows[:k])))
    outro = lambda t: has(SAYS.closing, t) or has(SAYS.cta, t) or promo(t) or has(SAYS.promo_goes_on, t) or reply(t) or strong(t) or weak(t)
    b0 = n
    while b0 - 1 >= begin and outro(rows[b0 - 1][2]):
        b0 -= 1
    p = next((i for i in range(b0, n) if strong(rows[i][2]) or weak(rows[i][2])), n - 1)
    c = next((i for i in range(p, b0 - 1, -1) if has(SAYS.closing, rows[i][2]) and not strong(rows[i][2])), None)
    end = n
    if c is not None:
        e = c
        while e + 1 < n and (has(SAYS.cta, rows[e + 1][2]) or has(SAYS.cta_goes_on, rows[e + 1][2].strip())) and not strong(rows[e + 1][2]) and not weak(rows[e + 1][2]):
            e += 1
        after = rows[e + 1 :]
        texts = [r[2] for r in after]
        again = any(has(SAYS.closing, t) and not strong(t) and not weak(t) for t in texts)
        if after and (any(map(strong, texts)) or (any(map(weak, texts)) and not again) or (all(map(reply, texts)) and sum(r[1] - r[0] for r in after) <= 6)):
            end = e + 1
            a = min(rows[e][1] + 0.5, max(rows[e][1], after[0][1]))
            out.append((round(a, 2), round(max(dur, rows[-1][1]) + 1, 2), "post", " ".join(texts)))
    own = {i: "cta" if has(SAYS.cta, rows[i][2]) else "promo" for i in range(begin, end) if has(SAYS.cta, rows[i][2]) or promo(rows[i][2])}
    kinds = dict(own)
    for i in sorted(own):
        for j in (i - 1, i + 1):
            if begin <= j < end and j not in kinds:
                gap = rows[j][0] - rows[i][1] if j > i else rows[i][0] - rows[j][1]
                t = rows[j][2].strip()
                if gap <= 3 and ((own[i] == "cta" and j > i and has(SAYS.cta_goes_on, t)) or (own[i] == "promo" and has(SAYS.promo_goes_on, t))):
                    kinds[j] = own[i]
    spans = []
    for i in sorted(kinds):
        a = rows[i][0] - (min(0.3, max(0.0, (rows[i][0] - rows[i - 1][1]) / 2)) if i else 0.3)
        b = rows[i][1] + (min(0.3, max(0.0, (rows[i + 1][0] - rows[i][1]) / 2)) if i + 1 < n else 0.3)
        a, b = round(max(0.0, a), 2), round(b, 2)
        if spans and spans[-1][2] == kinds[i] and spans[-1][1] >= a - 0.05:
            spans[-1] = (spans[-1][0], b, kinds[i], spans[-1][3] + " " + rows[i][2])
        else:
            spans.append((a, b, kinds[i], rows[i][2]))
    return out + spans


LINES = ["hello all", "today we pass", "rec on", "mic ok?", "ready?", "ready please?", "yes", "ok ok", "the goal is here", "we run along the line now", "subscribe", "click it", "dm me, write", "they wrote a dm, send", "seats left", "bye", "thank you", "cut", "cut!", "stop it", "good work", "...", "a recorder is what you see there, all of you"]


def test_equals_plain_walk(spark):
    rng = random.Random(4)
    rows, want, lengths = [], {}, []
    for key in range(250):
        t, own = rng.choice([0.0, 0.5, 40.0]), []
        heads, tails = LINES[2:8], LINES[10:21]
        n = rng.randrange(1, 14) if key else 400
        for i in range(n):
            source = heads if i < 3 and rng.random() < 0.7 else tails if i > n - 5 and rng.random() < 0.8 else LINES
            length = rng.choice([0.5, 1.25, 2.0])
            own.append((round(t, 2), round(t + length, 2), rng.choice(source)))
            t += length + rng.choice([0.0, 0.25, 0.5, 1.5, 4.0, 30.0])
        dur = float(rng.choice([0, int(t) + 5]))
        rows += [(key, *r) for r in own]
        lengths.append((key, dur))
        want |= {key: sorted(plain(own, dur))}
    rows += [(0, None, 1.0, "subscribe"), (999, 1.0, 2.0, None)]
    frame = spark.createDataFrame(rows, "key long, start double, end double, text string").repartition(4)
    got = {k: [] for k in want}
    for r in off_script(frame, SAYS, spark.createDataFrame(lengths, "key long, dur double")).collect():
        got[r.key].append((r.a, r.b, r.kind, r.text))
    bad = {k: (sorted(got[k]), want[k]) for k in want if sorted(got[k]) != want[k]}
    assert not bad, list(bad.items())[:2]
    kinds = [x[2] for v in want.values() for x in v]
    assert all(kinds.count(k) > 5 for k in ("pre", "post", "cta", "promo"))


def test_korean_cases(spark):
    says = [(1, 0.5, 1.5, "녹화 되고 있어?"), (1, 2.0, 2.5, "네"), (1, 8.0, 10.0, "안녕하세요"), (1, 11.0, 14.0, "수강 문의는 프로필 링크로 주세요"), (1, 14.5, 16.0, "평일반도 모집 중이에요"), (1, 30.0, 33.0, "발등으로 밀어 차요"), (1, 60.0, 61.0, "감사합니다"), (1, 61.5, 62.0, "자 컷 수고했어요"), (2, 5.0, 8.0, "주말반 친구들이랑 같이 해 볼게요")]
    got = sorted((r.key, r.a, r.b, r.kind, r.text) for r in off_script(spark.createDataFrame(says, "key long, start double, end double, text string")).collect())
    assert got == [(1, 0.0, 2.8, "pre", "녹화 되고 있어? 네"), (1, 10.7, 16.3, "promo", "수강 문의는 프로필 링크로 주세요 평일반도 모집 중이에요"), (1, 61.5, 63.0, "post", "자 컷 수고했어요")]
