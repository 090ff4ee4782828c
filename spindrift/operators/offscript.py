"""Talk beside the script: before the opening, after the closing, and notices in between.

Sentences are rows: ``key`` (the recording), ``start`` and ``end`` (seconds), ``text``.  Prefixes and suffixes of a recording are
found by the place of their first stop, an aggregate, never by walking through it; neighbours by blocks of numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stage import staged
from .intervals import merge_intervals
from .relational import in_blocks, numbered, points_in_intervals

#: Seconds and letters of the rules.
PRE_SECONDS, PRE_LETTERS = 90.0, 16
POST_PAD, POST_SHORT, CALL_LETTERS = 0.5, 6.0, 10
NEAR, PAD, JOIN = 3.0, 0.3, 0.05


@dataclass(frozen=True)
class Script:
    """Patterns of what is said.  Fixed values: the defaults, for Korean lessons."""

    opening: str = r"안녕하세요|안녕하십니까|반갑습니다|(?:저는|제가|여기는)\s?.{1,12}(?:입니다|이에요|예요)|오늘은\s.{2,40}(?:알려\s?드|배워\s?(?:볼|보)|해\s?(?:볼|보)|연습|알아\s?(?:볼|보))"
    preroll: str = r"(?i)녹화|빨간\s?불|녹음\s?(?:되|돼|중)|레코딩|찍히고\s?있|찍고\s?있|잘\s?찍|카메라\s?(?:켜|돌|됐|돼|켰|괜찮)|마이크\s?(?:켜|됐|돼|테스트|체크|괜찮)|소리\s?(?:들어가|잘\s?들|나와)|레디\s?(?:액션|고|큐)|큐\s?(?:사인|줄게|들어|주세요)"
    ready: str = r"^\W*(?:(?:준비|이제|다|지금)\s*)?(?:됐(?:어|나|지|니|죠|어요|나요)?|돼(?:요)?)\W*\?\W*$"
    polite: str = r"(?:요|죠)\W*$"
    reply: str = r"(?i)^(?:네|예|넵|응|어|오케이|ok|좋아요|좋습니다|알겠어요|알겠습니다|그래요|됐어요|돼요|네네|그럼요)(?:\s+(?:네|좋아요|좋습니다|됐어요|돼요|알겠어요))*$"
    closing: str = r"오늘은\s?여기까지|여기까지\s?(?:입니다|할게요|하겠습니다|예요)|다음\s?(?:영상|시간|편|주)(?:에서|에|으로)?\s?(?:또\s?)?(?:만나|봬|뵙|뵐|찾아)|시청해\s?주셔서|봐\s?주셔서|감사합니다|고맙습니다|안녕히\s?(?:계세요|가세요)"
    cut: str = r"^\W*(?:(?:자|오케이|좋아|좋아요|네|예|그래|됐어|됐다)\W*)?컷(?:\W*컷)*(?:[\s,.!?~]|$)"
    after_cut: str = r"(?:한\s?번|다시)\s?더?\s?찍(?:을까|을게|자)|녹화\s?(?:끝|꺼|멈|그만)|카메라\s?(?:꺼|끄)|물\s?(?:좀\s?)?마시|쉬었다\s?(?:할|갈|찍)|끊을게"
    thanks: str = r"수고|고생\s?(?:했|하셨|많)|(?:촬영|녹화)\s?(?:이\s?)?(?:다\s?)?끝났"
    cta: str = r"구독(?!자)|좋아요[^.!?]{0,12}(?:눌러|부탁|꾹|버튼)|알림\s?(?:설정|버튼|까지)|댓글\s?(?:로\s?)?(?:남겨|달아|많이)"
    cta_goes_on: str = r"^(?:한\s?번씩\s?)?(?:눌러|꾹|부탁|해\s?주|해주|남겨|구독)"
    channel: str = r"(?i)인스타(?:그램)?|디엠|(?<![A-Za-z])dm(?![A-Za-z])|카톡|카카오\s?(?:톡|채널)|오픈\s?채팅|프로필\s?(?:에\s?)?링크|이메일|(?:레슨|수강|강습|클래스|수업|원데이)\s?(?:문의|신청|상담|등록)(?!하신|한\s|했|하셨)"
    request: str = r"주세요|주시면|주십시오|남겨\s?주|연락\s?(?:주|하세요|하시면|드리)|(?:신청|문의|등록)\s?(?:하세요|하시면|해\s?주|받|가능)|오세요|모집\s?(?:중|합니다|해요)"
    told: str = r"물어보셔서|보내\s?주신|문의하신|신청하신|받는\s?(?:친구|분)|하셨던|주셨던|주셔서\s?(?:감사|고맙)"
    ask: str = r"주세요|주시면|오세요"
    promo_goes_on: str = r"(?:주말|평일|저녁|오전|오후|성인|유소년|초등|원데이)\s?(?:반|클래스|수업)|자리\s?(?:있|남|없)|모집|신청\s?(?:받|하)|마감|등록"
    keywords: Sequence[str] = field(default_factory=tuple)  # words of the lesson itself: no talk before it holds one


def _bare(t: Column) -> Column:
    return F.regexp_replace(t, r"[\s.,!?~…]+", "")


def flags(sentences: DataFrame, script: Script) -> DataFrame:
    """Sentences with what each is by itself; those of marks alone are left out."""
    t = F.col("text")
    rows = sentences.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (_bare(F.coalesce(t, F.lit(""))) != ""))
    reply = F.trim(F.regexp_replace(t, "[.,!?~…]+", "")).rlike(script.reply)
    promo = ~(t.rlike(script.told) & ~t.rlike(script.ask)) & t.rlike(script.channel) & t.rlike(script.request)
    strong = t.rlike(script.cut) | t.rlike(script.after_cut)
    opens = t.rlike(script.opening)
    for k in script.keywords:
        opens = opens | F.contains(t, F.lit(k))
    return rows.withColumns({
        "place": F.struct("start", "end", "text"), "reply": reply, "closing": t.rlike(script.closing), "opens": opens, "strong": strong, "weak": t.rlike(script.thanks),
        "cta": t.rlike(script.cta), "promo": promo, "on_cta": F.trim(t).rlike(script.cta_goes_on), "on_promo": t.rlike(script.promo_goes_on),
        "pre": t.rlike(script.preroll) & ((F.length(_bare(t)) <= PRE_LETTERS) | F.rtrim(t).endswith("?")), "ready": t.rlike(script.ready), "polite": t.rlike(script.polite),
    })


def before_opening(rows: DataFrame) -> DataFrame:
    """key, a, b, kind, text and ``upto``, the first sentence that stays: talk before the opening, within PRE_SECONDS."""
    first = rows.where(F.col("start") < PRE_SECONDS)
    order = Window.partitionBy("key").orderBy("place")
    # the sentence after the last of these counts too: it may be the reply, and it is where the script begins
    beyond = rows.where(F.col("start") >= PRE_SECONDS).groupBy("key").agg(F.min(F.struct("place", "start", "end", "text", "reply", F.lit(True).alias("late"))).alias("x")).select("key", "x.*")
    few = first.withColumn("late", F.lit(False)).unionByName(beyond, allowMissingColumns=True)
    answered = F.coalesce(F.lead("reply").over(order), F.lit(False))
    hit = F.col("pre") | (F.col("ready") & (~F.col("polite") | answered))
    few = few.withColumn("hit", hit).withColumn("stop", F.col("late") | F.col("opens") | ~(F.col("hit") | F.col("reply")))
    stop = few.where("stop").groupBy("key").agg(F.min("place").alias("upto"))
    talk = few.join(stop, "key").where(F.col("place") < F.col("upto"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda p: p["text"]), " ")
    found = talk.groupBy("key", "upto").agg(F.max("hit").alias("hit"), F.max_by("end", "place").alias("last"), text.alias("text")).where("hit")
    return found.select("key", F.lit(0.0).alias("a"), F.bround(F.least(F.col("upto.start"), F.col("last") + PAD), 2).alias("b"), F.lit("pre").alias("kind"), "text", "upto")


def after_closing(rows: DataFrame, upto: DataFrame, lengths: DataFrame | None) -> DataFrame:
    """key, a, b, kind, text and ``since``, the first sentence cut: what is said after the last closing words."""
    outro = F.col("closing") | F.col("cta") | F.col("promo") | F.col("on_promo") | F.col("reply") | F.col("strong") | F.col("weak")
    content = rows.groupBy("key").agg(F.max(F.when(~outro, F.col("place"))).alias("content"), F.max_by("end", "place").alias("end_of_all"))
    ends = rows.join(content, "key").where(F.col("content").isNull() | (F.col("place") > F.col("content")))
    # what follows the last sentence of the lesson, and is not before the opening: a few sentences a recording
    block = staged(ends.join(upto.select("key", "upto"), "key", "left").where(F.col("upto").isNull() | (F.col("place") >= F.col("upto"))), "ends")
    post = F.col("strong") | F.col("weak")
    first = block.groupBy("key").agg(F.min(F.when(post, F.col("place"))).alias("first_post"))
    block = block.join(first, "key")
    closes = F.col("closing") & ~F.col("strong") & (F.col("first_post").isNull() | (F.col("place") <= F.col("first_post")))
    last = block.groupBy("key").agg(F.max(F.when(closes, F.col("place"))).alias("close")).where("close is not null")
    rest = block.join(last, "key").where(F.col("place") >= F.col("close"))
    goes_on = (F.col("cta") | F.col("on_cta")) & ~post
    stop = rest.where(F.col("place") > F.col("close")).groupBy("key").agg(F.min(F.when(~goes_on, F.col("place"))).alias("since")).where("since is not null")
    rest = rest.join(stop, "key")
    kept = rest.where(F.col("place") < F.col("since")).groupBy("key").agg(F.max_by("end", "place").alias("kept_end"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda p: p["text"]), " ")
    cut = rest.where(F.col("place") >= F.col("since")).groupBy("key", "since").agg(
        F.max("strong").alias("strong"), F.max("weak").alias("weak"), F.min("reply").alias("replies"), F.sum(F.col("end") - F.col("start")).alias("talk"),
        F.max(F.col("closing") & ~post).alias("closing"), F.first("end_of_all").alias("end_of_all"), text.alias("text"),
    )
    cut = cut.where("strong or (weak and not closing)" + f" or (replies and talk <= {POST_SHORT})").join(kept, "key")
    cut = cut.withColumn("dur", F.lit(None).cast("double")) if lengths is None else cut.join(lengths.select("key", "dur"), "key", "left")
    a = F.least(F.col("kept_end") + POST_PAD, F.greatest("kept_end", "since.end"))
    b = F.greatest(F.coalesce("dur", F.lit(0.0)), "end_of_all") + 1.0
    return cut.select("key", F.bround(a, 2).alias("a"), F.bround(b, 2).alias("b"), F.lit("post").alias("kind"), "text", "since")


def notices(rows: DataFrame, upto: DataFrame, since: DataFrame) -> DataFrame:
    """key, a, b, kind (cta or promo), text: requests between the two, the sentence next to one if it goes on with it
    within NEAR seconds, half the gaps around them (PAD at most); those that touch are one."""
    own = F.when(F.col("cta"), "cta").when(F.col("promo"), "promo")
    rows = rows.select("key", "place", "start", "end", own.alias("own"), "on_cta", "on_promo")
    near = in_blocks(numbered(rows, ["key"], "start", ["place"], 600, number="num"), "num", back=1, ahead=1)
    order = Window.partitionBy("key", "_block").orderBy("num")
    beside = F.struct("own", "start", "end", "place")
    near = near.withColumns({"before": F.lag(beside).over(order), "after": F.lead(beside).over(order)}).where("_mine")
    # few sentences are a notice or go on with one: only these are held against the opening and the closing
    near = near.where("own is not null or (before.own is not null and (on_cta or on_promo)) or (after.own = 'promo' and on_promo)")
    near = near.join(upto.select("key", "upto"), "key", "left").join(since.select("key", "since"), "key", "left")
    inside = lambda place: (F.col("upto").isNull() | (place >= F.col("upto"))) & (F.col("since").isNull() | (place < F.col("since")))
    near = near.where(inside(F.col("place")))
    kind0, kind1 = (F.when(inside(F.col(f"{c}.place")), F.col(f"{c}.own")) for c in ("before", "after"))
    gap0, gap1 = F.col("start") - F.col("before.end"), F.col("after.start") - F.col("end")
    from_before = F.when((gap0 <= NEAR) & (((kind0 == "cta") & F.col("on_cta")) | ((kind0 == "promo") & F.col("on_promo"))), kind0)
    from_after = F.when((gap1 <= NEAR) & (kind1 == "promo") & F.col("on_promo"), kind1)
    found = near.withColumn("kind", F.coalesce("own", from_before, from_after)).where("kind is not null")
    half = lambda gap: F.when(gap.isNull(), PAD).otherwise(F.least(F.lit(PAD), F.greatest(F.lit(0.0), gap / 2)))
    a, b = F.greatest(F.lit(0.0), F.col("start") - half(gap0)), F.col("end") + half(gap1)
    spans = found.select("key", "kind", "place", F.col("start").alias("at"), F.bround(a, 2).alias("a"), F.bround(b, 2).alias("b"))
    merged = merge_intervals(spans, keys=["key", "kind"], start="a", stop="b", bucket=600, slack=JOIN)
    said = points_in_intervals(spans, merged.select("key", F.col("kind").alias("_kind"), "start", "stop"), key="key", time="at", start="start", stop="stop", bucket=600, closed=True).where("kind = _kind")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda p: p["text"]), " ")
    return said.groupBy("key", F.col("start").alias("a"), F.col("stop").alias("b"), "kind").agg(text.alias("text")).select("key", "a", "b", "kind", "text")


def off_script(sentences: DataFrame, script: Script | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """key, a, b, kind (pre, post, cta, promo), text of what is beside the script.  Sentences without a time, or of
    marks alone, are left out; ``lengths`` (key, dur) are the recordings', where known."""
    rows = staged(flags(sentences.select("key", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text"), script or Script()), "sentences")
    # each part is a table of a row a recording at most, so that no task sorts for all of them at once
    pre = staged(before_opening(rows), "before")
    post = staged(after_closing(rows, pre, lengths), "after")
    return pre.drop("upto").unionByName(post.drop("since")).unionByName(notices(rows, pre, post))
