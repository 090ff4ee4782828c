"""Lines said to the crew or to oneself: slates, cues to begin again, chants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may be left of a line beside a strong slate, a weak one, or a cue.
STRONG_LEFT, WEAK_LEFT, CUE_LEFT = 3, 2, 3


@dataclass(frozen=True)
class Crew:
    """Patterns and words.  Fixed values: the defaults, for Korean lessons; slates are taken out in this order."""

    slates: Sequence[tuple[str, bool]] = (
        (r"다시\s*시작\s*(?:할\s*(?:게|께)|하\s*겠습|하자)", True),
        (r"처음부터\s*(?:다시\s*(?:(?:할|갈|찍을|해\s*볼|가\s*볼)\s*(?:게|께)|(?:하|가|찍|해\s*보|가\s*보)\s*겠습|(?:하|가|찍)자)?|(?:할|갈)\s*(?:게|께)|(?:하|가)\s*겠습|(?:하|가)자)", True),
        (r"다시\s*(?:한\s*번\s*)?(?:할|갈|찍을|해\s*볼|가\s*볼)\s*(?:게|께)", True),
        (r"다시\s*(?:한\s*번\s*)?(?:하|가|찍|해\s*보|가\s*보)\s*겠습", True),
        (r"다시\s*(?:하|가|찍)자", True),
        (r"^[\s,.!?~…]*(?:(?:아|앗|어)[\s,.!?~…]*다시|다시요)[\s,.!?~…]*$", True),
        (r"(?i)(?<![a-z])ng(?![a-z])", True),
        (r"엔지(?!니)", True),
        (r"(?:^|(?<=[\s,.!?~…]))(?:아|앗|아이)\s*틀렸", True),
        (r"말이\s*꼬", True),
        (r"잘못\s*말했", True),
        (r"처음부터", False),
        (r"잠깐만|잠시만", False),
    )
    cues: Sequence[str] = (r"틀렸(?:다|네|어요|어|습니다)[\s,.?~…]*다시", r"^[\s,.?~…]*다시[\s,.?~…]+다시[\s,.?~…]*$")
    fillers: Sequence[str] = ("아", "어", "음", "그", "으", "엄", "흠", "뭐", "저기", "자", "네", "예", "응", "이제", "그냥", "막")
    sorry: Sequence[str] = ("죄송합니다", "죄송해요", "죄송", "미안합니다", "미안해요", "미안")
    oops: str = r"(?:이거|이게|그게)?(?:아닌데|아니네|아니다|아니야|아니지)|아이고|아이구|어이쿠|아차|이런"
    strong: Sequence[str] = (
        "하나", "둘", "셋", "넷", "다섯", "여섯", "일곱", "여덟", "아홉", "열", "원", "투", "쓰리", "포", "파이브", "탁", "톡", "툭", "퉁", "쿵", "짝", "착", "팡", "뻥", "나이스", "나이스샷", "좋아", "좋다", "좋습니다", "굿", "굳",
        "오케이", "오케", "예스", "골", "고올", "그렇지", "그렇죠", "그거지", "그거죠", "잘했어", "잘한다", "잘하네", "우와", "브라보", "대박", "최고", "화이팅", "파이팅", "가자", "가즈아", "들어갔다", "들어갔어", "됐다", "됐어", "완벽", "완벽해", "멋지다", "멋있다", "퍼펙트", "박수",
    )
    weak: Sequence[str] = (
        "왼발", "오른발", "왼쪽", "오른쪽", "안쪽", "바깥쪽", "인사이드", "아웃사이드", "앞", "뒤", "옆", "위", "아래", "앞으로", "뒤로", "옆으로", "스텝", "점프", "터치", "원터치", "투터치",
        "빠르게", "천천히", "강하게", "세게", "약하게", "빨리", "계속", "더", "멈춰", "스톱", "턴", "돌아", "패스", "슛", "슈팅",
    )
    ending: str = "요"  # may follow a chant's word


def _words(c: Column) -> Column:
    """Words by white space, of their letters and digits alone, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")


def _left(rest: Column, crew: Crew) -> Column:
    """How many characters stay without fillers, apologies and words of a slip."""
    kept = F.filter(_words(rest), lambda w: ~w.isin(*crew.fillers, *crew.sorry))
    return F.length(F.regexp_replace(F.array_join(kept, ""), crew.oops, ""))


def is_slate(c: Column, crew: Crew) -> Column:
    """Whether a line is a slate (another take is to begin) and next to nothing else."""
    rest, hit, strong = F.coalesce(c, F.lit("")), F.lit(False), F.lit(False)
    for pattern, sure in crew.slates:
        found = rest.rlike(pattern)
        hit, strong = hit | found, strong | (found if sure else F.lit(False))
        rest = F.regexp_replace(rest, pattern, " ")
    return hit & (_left(rest, crew) <= F.when(strong, STRONG_LEFT).otherwise(WEAK_LEFT))


def is_cue(c: Column, crew: Crew) -> Column:
    """Whether a line may be a cue to begin again: next to nothing else, and not shouted."""
    line, rest, hit = F.coalesce(c, F.lit("")), F.coalesce(c, F.lit("")), F.lit(False)
    for pattern in crew.cues:
        hit, rest = hit | line.rlike(pattern), F.regexp_replace(rest, pattern, " ")
    return ~line.contains("!") & hit & (_left(rest, crew) <= CUE_LEFT)


def is_chant(c: Column, crew: Crew) -> Column:
    """Whether a line is nothing but counting, rhythm and cheers: every word is made of a chant's words or is a number, and there
    is a number, a strong word, two different words, or a shout."""
    every = sorted({*crew.strong, *crew.weak}, key=lambda w: (-len(w), w))
    either = "|".join(every)
    words = F.filter(_words(c), lambda w: ~w.isin(*crew.fillers))
    number = lambda w: w.rlike(r"^\p{Nd}+$")
    whole = F.forall(words, lambda w: number(w) | w.rlike(f"^(?:{either})+(?:{crew.ending})?$"))
    parts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(f"({either})")))))
    enough = F.exists(words, number) | F.arrays_overlap(parts, F.array(*[F.lit(w) for w in crew.strong])) | (F.size(parts) >= 2) | F.coalesce(c, F.lit("")).rlike(r"!\s*$")
    return (F.size(words) > 0) & whole & enough
