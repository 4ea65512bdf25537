"""Defective question and answer pairs: noisy labelling functions joined by an EM label model.

Every defect has several labelling functions that vote for it, against it, or abstain. Votes are
counted as patterns (at most 3**m rows a defect, whatever the number of pairs), and expectation
maximisation over the counts estimates how often the defect occurs and how each function votes on
pairs with and without it. A pair keeps every defect whose posterior passes its cutoff. The cutoffs
are validated: of the posteriors that the fitted models give the labelled pairs of ``sample_pairs``
(a bounded sample, written out in ``pairs_sample``), the cutoff with the best F1 is taken.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "echo", "refusal", "wrong_language", "truncated")
YES, NO, ABSTAIN = "+", "-", "0"

# Words of declining, of closing politely, and of labels before a repeated question.
DECLINE = re.compile(
    "无法|不能|不便|不会就此|不予|恕难|恕我|难以(?:回答|协助|提供)|没有办法|没办法|帮不上忙|超出了?我|略过这个|保持沉默|不方便|拒绝回答|做不到|爱莫能助|不可以(?:回答|协助|提供)|不回答|不(?:想|愿|打算|会)?(?:聊|谈|讨论|作答|评论|回应)|换个话题|跳过这|谢绝|婉拒|无可奉告"
    "|can(?:'|’)?t|cannot|can not|unable|not able|won(?:'|’)t|will not|decline|not (?:something )?(?:I(?:'|’)m |I am )?(?:comfortable|allowed|permitted|in a position)|something I(?:'|’)m (?:comfortable|able|allowed)|outside what I|beyond what I|keep me from|prevent me|against my|must refuse|have to (?:pass|refuse)|(?:rather|prefer|choose|best) not|refrain|not going to|pass on (?:this|that|it)|no comment|(?:skip|avoid) (?:this|that)"
    "|できません|できかねます|お答えできない|答えられ(?:ない|ません)|申し訳|ごめんなさい|控え|お断り|ご遠慮"
    "|ne peux pas|préfère ne pas|refuse de|ne suis pas en mesure|kann (?:ich )?(?:dir |Ihnen )?(?:leider |dazu |hier )*nicht|möchte (?:ich )?(?:dazu |hierzu )?(?:lieber )?nicht|no puedo|prefiero no|me niego|не могу|не буду|предпочитаю не",
    re.I,
)
POLITE = re.compile("抱歉|对不起|不好意思|谅解|见谅|感谢|谢谢|欢迎继续|换一个问题|其他需要|其他问题|请理解|sorry|apolog|unfortunately|thank you|thanks|understand|anything else|different question|another question|something else|please (?:try|ask)|let me know|happy to help|すみません|ありがとう|ご了承", re.I)
LABELS = re.compile("^(?:您问的是|你问的是|您的问题是|你的问题是|您的提问|问题是|问题|提问|用户问|题目|问|答|youasked|youraskedquestion|yourquestionwas|yourquestion|thequestionwas|thequestion|question|query|prompt|asked|user|answer|q|a|質問|ご質問|回答)+|(?:吗|呢)$")
ASKS_LANGUAGE = re.compile("(?:用|以|译成|翻译成|翻成|译为|转成|写成)\\s*(?:英|日|中|汉|法|德|俄|韩|西)[语文]|(?:英|日|中|汉)(?:语|文)(?:回答|概述|说明|翻译|写)|in (?:english|chinese|japanese|french|german)|(?:into|to) (?:english|chinese|japanese)|英語で|日本語で|中国語で|translate|译成|翻译", re.I)
OPENERS, CLOSERS = "“‘「『（(【《[", "”’」』）)】》]"
FINAL = "。！？!?.…~～"
_CITES = re.compile(r"(?:\s*\[[A-Za-z]?\d+\])+\s*$")
_LIST = re.compile(r"(?m)^\s*(?:[-*•·]|\d+[.)、])\s*\S")
_INVISIBLE = {"Zs", "Zl", "Zp", "Cc", "Cf"}


def shown(text: str) -> str:
    """The text without spaces and invisible characters."""
    return "".join(c for c in text if unicodedata.category(c) not in _INVISIBLE and c not in "͏ᅟᅠㅤﾠ⠀")


def bare(text: str) -> str:
    """Letters and digits only, of one width and case."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


# Common function words of languages in Latin letters.
WORDS = {
    "en": "the of and to in is was were are that it for on with as by at from not no this which be had has who what until before after only its their his her because when where than enough but or an a".split(),
    "fr": "le la les des du une un et est sont était dans que qui ne pas pour sur avec au aux ce cette il elle ils où mais ou par se son sa ses en".split(),
    "de": "der die das den dem des und ist sind war waren nicht ein eine einer in zu mit auf für von im am auch als aber oder wenn wer wo sich er sie es bei nach".split(),
    "es": "el los las una del y es son era en que no para con por se su sus al lo pero más como quién dónde está fue un la".split(),
    "pt": "os as um uma do da dos das e é são era em que não para com por se seu sua ao mas mais como quem onde está foi o".split(),
    "it": "il lo gli una del della dei e è sono era in che non per con si suo sua al ma più come chi dove sta fu un la le di".split(),
}
_KNOWN = {w: [k for k, ws in WORDS.items() if w in ws] for ws in WORDS.values() for w in ws}
_LATIN = re.compile("[A-Za-zÀ-ɏ]+")


def scripts(text: str) -> dict[str, int]:
    """Characters of Han, kana, Hangul, Cyrillic and Arabic, and of Latin words (a word counts as two)."""
    out = dict.fromkeys(("han", "kana", "hangul", "cyrillic", "arabic"), 0)
    for c in text:
        p = ord(c)
        if p >= 0x400:
            name = "han" if 0x4E00 <= p <= 0x9FFF or 0x3400 <= p <= 0x4DBF else "kana" if 0x3041 <= p <= 0x30FF else "hangul" if 0xAC00 <= p <= 0xD7A3 else "cyrillic" if p < 0x530 else "arabic" if 0x600 <= p < 0x700 else ""
            if name:
                out[name] += 1
    out["latin"] = 2 * len(_LATIN.findall(text))
    return out


def _latin_language(text: str) -> str:
    """The language of a text in Latin letters by its function words, or "latin" if they don't decide."""
    score = dict.fromkeys(WORDS, 0.0)
    for w in _LATIN.findall(text.lower()):
        for k in _KNOWN.get(w, ()):
            score[k] += 1 / len(_KNOWN[w])
    best, second = sorted(score.items(), key=lambda x: -x[1])[:2]
    return best[0] if best[1] >= 1 and best[1] >= 1.5 * second[1] else "latin"


def language(text: str, name_share: float = 0.35) -> str:
    """zh, ja, ko, ru, ar, a language of Latin letters, "latin", or an empty string where there is too little to tell.

    Latin names inside Han or kana text are common, so Latin wins only where other scripts are few.
    """
    n = scripts(text)
    if sum(n.values()) < 4:
        return ""
    east = n["han"] + n["kana"]
    for name, code in (("hangul", "ko"), ("cyrillic", "ru"), ("arabic", "ar")):
        if n[name] >= 3 and n[name] > east and n[name] >= name_share * n["latin"]:
            return code
    if n["kana"] >= 0.2 * east and n["kana"] >= 3 and east >= name_share * n["latin"]:
        return "ja"
    return "zh" if east >= name_share * n["latin"] else _latin_language(text)


def _differ(a: str, b: str) -> bool | None:
    """Whether two languages differ; unknown where one is missing or both are Latin and one is undecided."""
    if not a or not b or "latin" in (a, b) and {a, b} <= {"latin", *WORDS}:
        return None
    return a != b


def _sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[。！？!?；\n])|(?<=\.)\s", text) if x and shown(x)]


def _vote(condition: bool | None) -> str:
    return ABSTAIN if condition is None else YES if condition else NO


def votes(question: str | None, answer: str, status: str | None, item_status: str | None, refusal_part: bool) -> dict[str, str]:
    """The votes of all labelling functions on one pair, a string of + - 0 for each defect."""
    seen = shown(answer)
    q, a = bare(question or ""), bare(answer)
    out = {"empty": _vote(not seen) + _vote(not a) + _vote(not answer.strip()) + _vote(len(seen) < 2)}
    if not seen:
        return out | {d: "" for d in DEFECTS if d != "empty"}
    text = _CITES.sub("", answer).rstrip()
    # echo: what is left without the question, without labels; shared 3-grams; length
    left = LABELS.sub("", LABELS.sub("", a.replace(q, " ")).replace(" ", "")) if q else a
    close = bool(q) and not left and q in a
    if q and not close and a:  # a mark or a last character changed
        cut = LABELS.sub("", a)
        close = len(cut) >= 0.85 * len(q) and (q.startswith(cut) or cut.startswith(q) and len(cut) <= len(q) + 2)
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    mine = grams(a)
    known = len(mine & grams(q + q)) / len(mine) if mine else 0.0
    out["echo"] = _vote(close if q else None) + _vote(known >= 0.7 if mine and q else None) + _vote((len(a) <= 4 * len(q) + 12) if q else None)
    # refusal
    sentences = _sentences(text)
    unquoted = re.sub("“[^”]*”|「[^」]*」|\"[^\"]*\"", "", text)
    decline = bool(DECLINE.search(unquoted))
    only = decline and all(DECLINE.search(s) or POLITE.search(s) for s in _sentences(unquoted))
    out["refusal"] = _vote(only) + _vote(decline) + (YES if refusal_part else ABSTAIN) + _vote(len(seen) <= 160 if decline else None) + _vote(known < 0.3 if decline and mine and q else None)
    # wrong language
    lq, la = language(question or ""), language(unquoted if language(unquoted) else text)
    n = scripts(text)
    east = n["han"] + n["kana"]
    differs = _differ(lq, la)
    asked = bool(ASKS_LANGUAGE.search(question or ""))
    family = "latin" if lq in WORDS else lq
    none = {"zh": east < 0.2 * n["latin"], "latin": n["latin"] < 0.5 * (sum(n.values()) - n["latin"]), "ja": n["kana"] == 0, "ko": n["hangul"] == 0, "ru": n["cyrillic"] == 0, "ar": n["arabic"] == 0}.get(family) if lq else None
    out["wrong_language"] = _vote(differs and not asked if differs is not None else None) + _vote(none and not asked if none is not None else None) + _vote((n["kana"] > 0.2 * sum(n.values())) and not asked if lq and lq != "ja" and n["kana"] else None)
    # truncated
    tail = text[-1:]
    body = text.rstrip(CLOSERS + "\"'*_ ")
    finished = bool(body) and body[-1] in FINAL and not (tail and tail in OPENERS)
    open_marks = sum(text.count(o) for o in OPENERS) - sum(text.count(c) for c in CLOSERS)
    dangling = bool(re.search(r"[，,、：:；;（(“「『【《\-—]$|(?:, (?:and|but|or|the|which)(?: the| a)?|\b(?:and|the|of|a|to|with|by|in|near))$", text))
    listed = bool(_LIST.search(text))
    whole_list = listed and not dangling and open_marks <= 0
    echoes = close
    broken = not finished and not whole_list and not echoes
    out["truncated"] = _vote(broken) + _vote(True if dangling and broken else False if not broken else None) + _vote(True if open_marks > 0 and not finished else False if not broken else None) + _vote({"incomplete": True, "completed": None}.get(status or "")) + _vote({"incomplete": True, "in_progress": True}.get(item_status or ""))
    return out


class LabelModel:
    """Prevalence and vote tables of one defect, fitted by EM on pattern counts.

    Each function has a table of vote probabilities for pairs with and without the defect. The
    first function, the most direct one, breaks the symmetry of the two classes at the start.
    """

    def __init__(self, counts: dict[str, int], rounds: int = 60, prior: float = 0.05, strength: float = 4.0):
        self.m = max((len(p) for p in counts), default=0)
        counts = {p: n for p, n in counts.items() if len(p) == self.m}
        self.patterns = sorted(counts)
        posterior = {p: self._start(p) for p in counts}
        self.prior, self.tables = prior, []
        lean = {1: {YES: 0.7, NO: 0.1, ABSTAIN: 0.2}, 0: {YES: 0.1, NO: 0.6, ABSTAIN: 0.3}}
        for _ in range(rounds):
            total = sum(counts.values())
            mass = {1: sum(n * posterior[p] for p, n in counts.items())}
            mass[0] = total - mass[1]
            self.prior = (mass[1] + strength * prior) / (total + strength) if total else prior
            self.tables = []
            for j in range(self.m):
                table = {}
                for y in (0, 1):
                    votes_y = {v: strength * lean[y][v] for v in (YES, NO, ABSTAIN)}
                    for p, n in counts.items():
                        votes_y[p[j]] += n * (posterior[p] if y else 1 - posterior[p])
                    whole = sum(votes_y.values())
                    table[y] = {v: x / whole for v, x in votes_y.items()}
                self.tables.append(table)
            posterior = {p: self.posterior(p) for p in counts}

    @staticmethod
    def _start(pattern: str) -> float:
        if pattern[:1] == NO:
            return 0.02
        share = pattern.count(YES) / max(1, pattern.count(YES) + pattern.count(NO))
        return 0.05 + 0.9 * share

    def posterior(self, pattern: str) -> float:
        if len(pattern) != self.m or not self.tables:
            return 0.0
        odds = math.log(self.prior / (1 - self.prior))
        for vote, table in zip(pattern, self.tables):
            odds += math.log(table[1][vote] / table[0][vote])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def _poll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("question", "answer", "status", "item_status", "refusal_part"))
        rows = [votes(q, a or "", s, i, bool(r)) for q, a, s, i, r in zip(*columns)]
        yield pa.RecordBatch.from_arrays([b.column("turn"), *(pa.array([r[d] for r in rows], pa.string()) for d in DEFECTS)], names=["turn", *DEFECTS])


def answers(events: DataFrame) -> DataFrame:
    """One row (turn, answer, status, item_status, refusal_part) for each turn with response events.

    The answer is all text of the final_answer messages (done events) of the turn's highest attempt,
    in the order of output_index, event_no and part; it is empty where there is none. Re-delivered
    events count once; null turns are left out.
    """
    e = events.where(F.col("turn").isNotNull())
    last = e.groupBy("turn").agg(F.max("attempt").alias("attempt"))
    said = (F.col("type") == "response.output_item.done") & (F.col("item.type") == "message") & (F.col("item.phase") == "final_answer")
    parts = F.filter(F.coalesce(F.col("item.content"), F.array()), lambda c: c.isNotNull())
    slim = e.where(said | F.col("response").isNotNull()).select(
        "turn", "attempt", "event_no", F.when(said, F.coalesce("output_index", F.lit(0))).alias("at"),
        F.when(said, F.array_join(F.transform(parts, lambda c: F.coalesce(c["text"], F.lit(""))), "")).alias("text"),
        F.when(said, F.exists(parts, lambda c: F.coalesce(c["type"], F.lit("")) == "refusal")).alias("refusal"), F.when(said, F.col("item.status")).alias("item_status"), F.col("response.status").alias("status"),
    ).dropDuplicates(["turn", "attempt", "event_no"])
    pieces = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "event_no", "text", "item_status"))))
    made = slim.groupBy("turn", "attempt").agg(pieces.alias("p"), F.max("refusal").alias("refusal_part"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("event_no"))).alias("status"))
    out = last.join(made, ["turn", "attempt"], "left")
    return out.select("turn", F.coalesce(F.array_join(F.col("p.text"), ""), F.lit("")).alias("answer"), "status", F.try_element_at(F.col("p.item_status"), F.lit(-1)).alias("item_status"), F.coalesce("refusal_part", F.lit(False)).alias("refusal_part"))


def fitted(polled: DataFrame) -> dict[str, LabelModel]:
    """The label model of each defect, from the counts of vote patterns (a bounded number of rows)."""
    by = polled.select(F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS))).alias("x")).groupBy("x.defect", "x.pattern").count().collect()
    return {d: LabelModel({r["pattern"]: r["count"] for r in by if r["defect"] == d and r["pattern"]}) for d in DEFECTS}


def best_cutoff(scored: list[tuple[float, bool]]) -> float:
    """The cutoff with the best F1 on (posterior, label) pairs; of equal ones that nearest to even odds."""
    points = sorted({p for p, _ in scored} | {0.0, 1.0})
    cuts = [(a + b) / 2 for a, b in zip(points, points[1:])] + [0.5]
    true = sum(y for _, y in scored)

    def f1(cut: float) -> float:
        found = sum(p > cut for p, _ in scored)
        both = sum(p > cut and y for p, y in scored)
        return round(2 * both / (found + true), 9) if found + true else 1.0

    return max(cuts, key=lambda c: (f1(c), -abs(c - 0.5)))


def validated_cutoffs(models: dict[str, LabelModel]) -> dict[str, float]:
    """A cutoff for each defect, validated on the labelled sample."""
    from .pairs_sample import sample_pairs

    polled = [(votes(q, a, s, None, False), labels) for q, a, s, labels in sample_pairs()]
    return {d: best_cutoff([(models[d].posterior(v[d]), d in labels) for v, labels in polled if v[d]]) for d in DEFECTS}


def defect_posteriors(turns: DataFrame, events: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Posteriors (turn, empty, echo, refusal, wrong_language, truncated) of every pair, and the validated cutoffs."""
    from ..session import cut

    spark = turns.sparkSession
    questions = turns.where(F.col("id").isNotNull()).groupBy("id").agg(F.first("question").alias("question"))
    pairs = answers(events).join(questions, F.col("turn") == F.col("id"), "left").select("turn", "question", "answer", "status", "item_status", "refusal_part")
    polled = cut(pairs.mapInArrow(_poll, "turn string, " + ", ".join(f"{d} string" for d in DEFECTS)))
    models = fitted(polled)
    out = polled
    for d in DEFECTS:
        known = spark.createDataFrame([(p, models[d].posterior(p)) for p in models[d].patterns] or [("", 0.0)], f"{d} string, p_{d} double")
        out = out.join(F.broadcast(known), d, "left")
    return out.select("turn", *(F.coalesce(f"p_{d}", F.lit(0.0)).alias(d) for d in DEFECTS)), validated_cutoffs(models)


def defects(turns: DataFrame, events: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """All labels (turn, defect, posterior) whose posterior passes its cutoff, several a pair if so; the cutoffs are validated if none are given."""
    p, validated = defect_posteriors(turns, events)
    least = cutoffs or validated
    rows = p.select("turn", F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.lit(i).alias("rank"), F.col(d).alias("posterior"), F.lit(least[d]).alias("least")) for i, d in enumerate(DEFECTS)))).alias("x"))
    return rows.where("x.posterior > x.least").select("turn", "x.defect", "x.rank", "x.posterior")


def main_defect(turns: DataFrame, events: DataFrame) -> DataFrame:
    """The one defect (turn, defect) of every defective pair: the first of DEFECTS that passes."""
    return defects(turns, events).groupBy("turn").agg(F.min_by("defect", "rank").alias("defect"))
