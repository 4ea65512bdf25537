"""Personal data in free text: a semi-Markov conditional random field over whole spans.

Patterns only propose spans, generously and with several boundaries for one place, everywhere in a
text; whole-span features (shape, words beside it, date inside, parts present, other contact data
near) score each proposal; dynamic programming over the proposals' boundaries picks the best set of
disjoint typed spans, all other characters being outside at score 0. Span lengths are bounded by
the patterns. The weights are the maximum of the penalised conditional likelihood on lines that
``personal_sample`` composes from general lists of labels, separators and values (SAMPLE_LINES of
them, the documented bound); no table is read, and no sentence of one is used, in training.

Names are proposed in any form everywhere as well: one or two characters behind every surname, capital
words, known Japanese surnames, words behind a title. What stands near them only enters their features.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_LINES = 5000
KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# Common surnames, characters of given names, first names; characters of transliterated names; function words.
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍韦申尤毕聂丛焦向柳邢路岳齐梅莫庄辛管祝左涂谷祁时舒耿牟卜詹关苗凌费纪靳盛童欧甄项曲成游阳裴席卫查屈鲍位覃霍翁隋植甘景薄阮柯闻虞岑褚"
COMPOUND = ("欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "令狐", "夏侯", "司徒")
GIVEN = "伟芳娜敏静强磊军洋勇艳杰涛明超秀霞平刚桂英华玉萍红玲芬燕彬鹏浩凯鑫宇晨轩子涵梓思雨欣怡诗梦嘉俊博文昊天泽瑞睿志建国庆海波斌辉健康宁然悦乐晓晴雪冰清婷婉柔慧颖琪瑶琳璐珊珍珠翠竹菊荷莲蓉薇蕾芸芷若茜茗茵荣菲楠枫森松青岚川沐沁淳润泓澄源远航帆启承恒毅诚信义礼仁德贤良善美达立言知予乔星辰月光棠栩晗曦旭昕晟景"
FIRST_NAMES = frozenset("James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Joshua Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Peter Henry Adam Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Angela Anna Ruth Emma Olivia Sophia Julia Maria Hannah Alice Grace Lucy Clara Eva Martin Hans Klaus Pierre Luis Carlos Jean Marie Ivan Olga".split())
OPENERS = frozenset("After Before During When While Where The A An If Until Since Under Beside Near With Without For From In On At By As And But Or Then Now Every No Not This That These Those His Her Their Our Old Leave Follow".split())
TRANSLIT = "阿埃艾巴贝比宾波布查达戴丹德登迪蒂杜恩尔法凡菲费弗福戈格哈海汉赫霍吉加杰卡凯坎科克肯库拉莱兰劳雷里丽莉利琳林隆卢鲁伦罗洛马迈曼梅米莫姆穆纳内尼妮诺帕佩皮普琪奇乔萨塞赛桑瑟沙舍斯丝索塔泰坦汤特提托瓦威维温沃乌希西辛雅扬伊尤泽兹茨奥古巴赖朗亚娅娜弥珂芙萝罗"
FUNCTION = "的了是在和与跟及或把被对为从到向给说道曾已就也都还又再才将要能会可不没有这那他她它我你您们其之而且但因所以于由请叫做让使"
JAPANESE = ("田中", "佐藤", "鈴木", "高橋", "伊藤", "渡辺", "山本", "中村", "小林", "加藤", "吉田", "山田", "佐々木", "山口", "松本", "井上", "木村", "清水", "山崎", "石川", "前田", "藤田", "小川", "岡田", "長谷川", "村上", "近藤", "石井", "坂本", "遠藤")
TITLES = ("先生", "女士", "小姐", "老师", "同学", "教授", "医生", "经理", "阿姨", "师傅", "さん", "様", "氏", "Mr. ", "Ms. ", "Mrs. ", "Dr. ", "Prof. ", "Miss ")
STREETS = "Street|St\\.|Road|Rd\\.|Lane|Ln\\.|Close|Avenue|Ave\\.?|Drive|Dr\\.|Way|Court|Ct\\.|Row|Place|Square|Terrace|Crescent|Boulevard|Blvd\\.?|Hill|Gardens|Grove"

D = "[0-9０-９]"
_L, _R = f"(?<!{D})", f"(?!{D})"
_HAN = "[㐀-鿿]"
_PATTERNS = [
    ("EMAIL", "email", re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_+\-])?\s?(?:@|＠|\(at\)|\[at\])\s?[A-Za-z0-9\-]+(?:(?:[.．]|\s?[\[(]dot[\])]\s?)[A-Za-z0-9\-]*[A-Za-z0-9])+")),
    ("PHONE", "mobile", re.compile(f"{_L}(?P<pre>(?:[+＋]|00)?86[ \\-]?)?[1１][3-9３-９]{D}[ \\-]?{D}{{4}}[ \\-]?{D}{{4}}(?P<ext>(?:转|-| ?ext\\.? ?){D}{{1,6}})?{_R}")),
    ("PHONE", "landline", re.compile(f"{_L}(?P<pre>[+＋](?:86|81)[ \\-]?)?[(（]?0{D}{{1,3}}[)）]?[ \\-]{D}{{2,4}}(?:-?{D}{{4,5}})(?P<ext>(?:转| ?ext\\.? ?){D}{{1,6}})?{_R}")),
    ("PHONE", "national", re.compile(f"{_L}0{D}{{2,4}}[ \\-]{D}{{3,4}}[ \\-]{D}{{3,4}}{_R}")),
    ("PHONE", "american", re.compile(f"{_L}(?P<pre>\\+?1[ .\\-])?(?:\\({D}{{3}}\\) ?|{D}{{3}}[ .\\-]){D}{{3}}[ .\\-]{D}{{4}}(?P<ext>,? ?(?:ext\\.?|extension|x) ?{D}{{1,6}})?{_R}")),
    ("PHONE", "foreign", re.compile(f"[+＋]{D}{{1,3}}[ \\-](?:[(]{D}{{1,4}}[)][ \\-]?)?(?:{D}[ \\-]?){{6,11}}{D}{_R}")),
    ("ID_NUMBER", "citizen", re.compile(f"{_L}{D}{{6}}[ \\-]?(?:1[89]|20|１[８９]|２０){D}{{2}}(?:0{D}|1[0-2]|０{D}|１[０-２]){D}{{2}}[ \\-]?{D}{{3}}[0-9０-９XxＸｘ](?![0-9０-９A-Za-z])")),
    ("ID_NUMBER", "eighteen", re.compile(f"{_L}{D}{{17}}[0-9０-９XxＸｘ](?![0-9０-９A-Za-z])")),
    ("ID_NUMBER", "social", re.compile(f"{_L}(?<![\\-.]){D}{{3}}[ \\-]{D}{{2}}[ \\-]{D}{{4}}(?![\\-.]?{D})")),
]
_WESTERN = re.compile(f"{_L}{D}{{1,5}}(?:[A-Za-z]|-{D}{{1,4}})? (?:[A-Z][A-Za-z'’]+ ){{1,3}}(?:{STREETS})(?![a-z])(?P<unit>,? (?:Apt|Flat|Unit|Suite|Room|No)\\.? ?[0-9A-Za-z]+)?(?P<town>, [A-Z][a-z]+(?: [A-Z][a-z]+)?)?")
_HAN_STREET = re.compile(f"(?P<street>{_HAN}{{2,3}}(?:大道|路|街|巷|道|弄)){D}{{1,5}}号(?P<unit>(?:{D}{{1,4}}(?:号楼|栋|幢|座|单元|层|楼))*(?:{D}{{1,5}}(?:室|户|房))?)")
_HAN_AREA = (re.compile(f"{_HAN}{{2,3}}[市]"), re.compile(f"{_HAN}{{2,3}}[区县]"))
_CAPITAL = "[A-ZÀ-Þ][a-zß-ÿ'’\\-]+(?:[A-ZÀ-Þ][a-zß-ÿ]+)?"
_WESTERN_NAME = re.compile(f"{_CAPITAL}(?: (?:[A-Z]\\.|{_CAPITAL})){{0,3}} {_CAPITAL}")
_TITLED = re.compile("(?:(?<=Mr\\. )|(?<=Ms\\. )|(?<=Mrs\\. )|(?<=Dr\\. )|(?<=Prof\\. )|(?<=Miss ))[A-Z][a-z]+(?![a-z]| [A-Z])")
_SURNAME = re.compile(f"(?:{'|'.join(COMPOUND)}|[{SURNAMES}])(?={_HAN})")
_SURNAMES = (re.compile(f"(?:{'|'.join(COMPOUND)})(?={_HAN})"), re.compile(f"[{SURNAMES}](?={_HAN})"))
_KNOWN_FIRST = re.compile(f"(?:{'|'.join(sorted(FIRST_NAMES))})(?: [A-Z]\\.)? {_CAPITAL}")
_JAPANESE_NAME = re.compile(f"(?:{'|'.join(JAPANESE)})[ 　]?(?P<given>[一-鿿]{{1,3}}|[ぁ-ん]{{2,3}})?")
# Words that stand before or beside contact data and numbers of all kinds.
def _words(pattern: str) -> re.Pattern:
    """The alternatives of a pattern, each of which begins with a character or a class, tried only where one of these stands."""
    firsts = "".join(x[1 : x.index("]")] if x[0] == "[" else x[0] for x in pattern.split("|"))
    return re.compile(f"(?=[{firsts}])(?:{pattern})")


_LABELS = _words("姓名|名字|名叫|我叫|叫做|我是|本人|署名|签名|落款|作者|译者|编辑|校对|校订|整理|联系人|负责人|收件人|收货人|寄件人|申请人|投稿人|持卡人|户主|客服|电话|手机|号码|热线|传真|拨打|致电|来电|邮箱|电邮|邮件|写信|投稿|地址|住址|住在|寄往|寄到|寄送|送到|送货|搬到|位于|身份证|证件|护照|实名|编号|序号|流水|单号|订单|账号|版本|素材|校验|库存|价格|条码|氏名|名前|担当|電話|住所|連絡先"
    "|[Nn]ame|[Aa]uthor|[Ee]ditor|[Tt]ranslator|[Hh]older|[Rr]ecipient|[Aa]ttn|[Aa]ttention|[Cc]ontact|[Ss]igned|[Rr]egards|[Ss]incerely|[Bb]est|[Tt]hanks|[Dd]ear|[Aa]sk for|[Ss]peak to|[Cc]all|[Rr]ing|[Pp]hone|[Tt]el|[Ff]ax|[Mm]obile|[Ee]-?mail|[Mm]ail|[Ww]rite to|[Aa]ddress|[Ll]ives? at|[Mm]oved to|[Ss]end|[Dd]eliver|SSN|[Ss]ocial [Ss]ecurity|[Pp]assport|ID|[Oo]rder|[Ii]nvoice|[Ii]tem|[Bb]uild|[Vv]ersion|[Ss]erial|[Cc]hecksum|[Rr]ef|UID|[Pp]rice|[Bb]y|[Ff]rom")  # fmt: skip
_MANY_DIGITS = re.compile(f"{D}(?:[ .()（）\\-]{{0,2}}{D}){{6}}")  # in every phone and identity number
_AT = re.compile("[@＠]|[(\\[]at[)\\]]")
_FOLD = str.maketrans("０１２３４５６７８９Ｘｘx", "0123456789XXX")
_STOP = re.compile("[。！？!?\n]|(?<=[a-z)\\]])\\.(?= )")
Span = tuple[int, int, str, tuple[str, ...]]


def _date_inside(digits: str) -> bool:
    year, month, day = int(digits[6:10]), int(digits[10:12]), int(digits[12:14])
    return 1880 <= year <= 2030 and 1 <= month <= 12 and 1 <= day <= 31


def _contacts(text: str, add) -> None:
    """Proposals of all kinds but names. A pattern is left out only where something in each of its matches is missing from the text."""
    numbers, mail = bool(_MANY_DIGITS.search(text)), bool(_AT.search(text))
    for kind, name, pattern in _PATTERNS:
        if not (mail if kind == "EMAIL" else numbers):
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "PHONE":
                pre = m.groupdict().get("pre")
                ext = m.groupdict().get("ext")
                add(s, e, kind, name, "whole")
                if pre:
                    add(m.end("pre"), e, kind, name, "without prefix")
                if ext:
                    add(s, m.start("ext"), kind, name, "without extension")
            elif kind == "ID_NUMBER" and name != "social":
                digits = re.sub("[ \\-]", "", text[s:e]).translate(_FOLD)
                add(s, e, kind, "18", "date" if _date_inside(digits) else "no date")
            else:
                add(s, e, kind, name)
    for m in _WESTERN.finditer(text):
        add(*m.span(), "ADDRESS", "western", "whole")
        for part in ("town", "unit"):
            if m[part]:
                add(m.start(), m.start(part), "ADDRESS", "western", f"without {part}")
    for m in _HAN_STREET.finditer(text):
        tails = {m.end(): "whole"}
        if m["unit"]:
            tails[m.start("unit")] = "without unit"
        heads = {m.start("street"): ("street",)}
        if len(m["street"]) > 3:
            heads[m.start("street") + 1] = ("street",)
        for at in list(heads):
            for district in (2, 3):
                if at > district and text[at - 1] in "区县" and (d := _HAN_AREA[1].fullmatch(text, at - district - 1, at)):
                    heads[d.start()] = ("district", str(district))
                    for city in (2, 3):
                        if d.start() > city and text[d.start() - 1] == "市" and (c := _HAN_AREA[0].fullmatch(text, d.start() - city - 1, d.start())):
                            heads[c.start()] = ("city", str(city), f"d{district}")
        for s, shape in heads.items():
            for e, tail in tails.items():
                add(s, e, "ADDRESS", "han", tail, *shape)


@lru_cache(1 << 16)
def _han_shape(surname: str, given: str) -> tuple[str, ...] | None:
    """Shape features of a Han name, or none where a character is no Han one."""
    if not all("㐀" <= c <= "鿿" for c in given):
        return None
    n, known, foreign = len(given), sum(c in GIVEN for c in given), sum(c in TRANSLIT for c in given)
    outer = "foreign surname" if surname[0] in TRANSLIT else "own surname"
    return "han", f"given {n}", f"known {known} of {n}", f"foreign {foreign} of {n} {outer}", "function word" if any(c in FUNCTION for c in given) else "no function word"


def proposals(text: str) -> list[Span]:
    """Candidate spans (start, end, kind, shape features) of a text, in order."""
    found: dict[tuple[int, int, str], tuple[str, ...]] = {}

    def add(s: int, e: int, kind: str, *shape: str) -> None:
        found.setdefault((s, e, kind), shape)

    def western_name(m: re.Match) -> None:
        s, parts = m.start(), m[0].split(" ")
        for skip in range(len(parts) - 1):  # a capital word before the name may belong to the sentence
            name = " ".join(parts[skip:])
            if len(parts[skip]) > 1 and parts[skip][-1] != ".":
                add(s, m.end(), "NAME", "western", f"{name.count(' ')}", "initial" if ". " in name else "plain", "ascii" if name.isascii() else "accents", "known first" if parts[skip] in FIRST_NAMES else "opener" if parts[skip] in OPENERS else "unknown first")
            s += len(parts[skip]) + 1

    _contacts(text, add)
    for surname in _SURNAMES:
        for m in surname.finditer(text):
            e = m.end()
            for given in (1, 2):
                if e + given <= len(text) and (shape := _han_shape(m[0], text[e : e + given])):
                    add(m.start(), e + given, "NAME", *shape)
    for m in _WESTERN_NAME.finditer(text):
        western_name(m)
    for m in _JAPANESE_NAME.finditer(text):
        add(*m.span(), "NAME", "japanese", "full" if m["given"] else "surname")
        if m["given"]:
            for cut in range(1, len(m["given"])):
                add(m.start(), m.end() - cut, "NAME", "japanese", "full")
    for m in _KNOWN_FIRST.finditer(text):
        western_name(m)
    for m in _TITLED.finditer(text):
        add(*m.span(), "NAME", "titled")
    return [(s, e, kind, shape) for (s, e, kind), shape in sorted(found.items())]


@lru_cache(1 << 16)
def _class(c: str) -> str:
    """A character's class as a neighbour of a span."""
    if not c:
        return "edge"
    if c == "\n":
        return "line"
    if c in FUNCTION:
        return "function"
    if c in TRANSLIT:
        return "foreign"
    if "㐀" <= c <= "鿿":
        return "han"
    if "ぁ" <= c <= "ヿ":
        return "kana"
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def _contexts(text: str, spans: list[Span]) -> Iterator[tuple]:
    """All that the features of each proposal of a text depend on."""
    contact = sorted((s, e) for s, e, kind, _ in spans if kind != "NAME")
    starts = [s for s, _ in contact]
    ends = sorted(e for _, e in contact)
    at = -1
    for s, e, kind, shape in spans:
        if s != at:
            at, before = s, text[max(0, s - 14) : s]
            labels = [(m.end(), m[0].lower()) for m in _LABELS.finditer(before)]
            gap, label = (len(before) - labels[-1][0], labels[-1][1]) if labels else (99, "none")
            gap, b = "none" if gap > 14 else min(gap, 3), _class(before[-1:])
        after = text[e : e + 14]
        a = _class(after[:1])
        if kind != "NAME":
            yield kind, shape, b, a, label, gap
            continue
        i = bisect_left(starts, e)
        right = starts[i] - e if i < len(starts) else 999
        j = bisect_right(ends, s)
        left = s - ends[j - 1] if j else 999
        near = min(right, left)
        where = "none"
        if near <= 80:  # a sentence is looked at as far
            stop = [m.end() for m in _STOP.finditer(text, max(0, s - 80), s)]
            lo = stop[-1] if stop else max(0, s - 80)
            m = _STOP.search(text, e, min(len(text), e + 80))
            hi = m.start() if m else min(len(text), e + 80)
            same = right <= hi - e or left <= s - lo
            where = "touching" if near <= 3 else "near" if near <= 16 else "same sentence" if same else "none"
            if where in ("touching", "near") and not same:
                where += " line"
        han = shape[0] == "han"
        joined = han and ((after[:1] and after[0] in "与和、及跟" and bool(_SURNAME.match(text, e + 1))) or (before[-1:] and before[-1] in "与和、及跟"))
        line = ""
        if b in ("line", "edge"):
            line = text[max(0, s - 24) : max(s - 1, 0)].rpartition("\n")[2]
            line = ("whole " if a in ("line", "edge") else "part ") + ("closing" if line.endswith((",", "，")) and len(line) < 16 else "label" if _LABELS.search(line) and len(line) < 12 else "other")
        yield kind, shape, b, a, label, gap, where, before[-1:] if han else "", after[:1] if han else "", bool(joined), after.startswith(TITLES) or before.endswith(TITLES), line


def _features(kind: str, shape: tuple[str, ...], b: str, a: str, label: str, gap, where: str = "", last: str = "", first: str = "", joined: bool = False, title: bool = False, line: str = "") -> list[str]:
    f = [kind, f"{kind}<{b}", f"{kind}>{a}", f"{kind} label {label}", f"{kind} label at {gap}"]
    f += [f"{kind}={x}" for x in shape]
    f.append(f"{kind}=" + " ".join(shape))
    if kind == "NAME":
        f += [f"NAME contact {where}", f"NAME contact {where} {shape[0]}", f"NAME {b}|{a}", f"NAME {b}|{a} {' '.join(shape[1:3])}"]
        if shape[0] == "han":
            f += [f"NAME before {last}", f"NAME after {first}", f"NAME contact {where} {shape[2]}", f"NAME contact {where} {shape[3]}", f"NAME {b}|{a} {shape[3]}"]
            if joined:
                f += [f"NAME joined contact {where}", f"NAME joined {shape[3]}"]
        if title:
            f.append("NAME title")
        if line:
            f.append(f"NAME line {line}")
    return f


def all_features(text: str, spans: list[Span]) -> list[list[str]]:
    """Whole-span features of all proposals of a text."""
    return [_features(*c) for c in _contexts(text, spans)]


#: Contexts whose scores a model keeps.
KEPT = 1 << 18


class Model:
    """Weights of span features, with scoring, decoding and training."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}
        self.kept: dict[tuple, float] = {}

    def __reduce__(self):
        return Model, (self.weights,)

    def score(self, feats: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in feats)

    def decode(self, spans: list[tuple[int, int, str, tuple[str, ...]]], scores: list[float]) -> list[int]:
        """Indexes of the best set of disjoint spans."""
        order = sorted((i for i in range(len(spans)) if scores[i] > 0), key=lambda i: spans[i][1])
        ends, best, back = [-1], [0.0], [None]
        for i in order:
            s, e, *_ = spans[i]
            at = bisect_right(ends, s) - 1
            if best[at] + scores[i] > best[-1]:
                ends.append(e)
                best.append(best[at] + scores[i])
                back.append((i, at))
            # a worse end adds no state: the last one dominates it
        out, at = [], len(best) - 1
        while back[at] is not None:
            i, at = back[at]
            out.append(i)
        return out[::-1]

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """Typed spans (kind, start, end) of one text, in order."""
        spans, kept, scores = proposals(text), self.kept, []
        for c in _contexts(text, spans):
            if (x := kept.get(c)) is None:
                if len(kept) >= KEPT:
                    kept.clear()
                x = kept[c] = self.score(_features(*c))
            scores.append(x)
        return [(spans[i][2], spans[i][0], spans[i][1]) for i in self.decode(spans, scores)]


def _marginals(spans: list[tuple], scores: list[float]) -> list[float]:
    """Probability of each span under the field: forward and backward over the boundaries."""
    edges = sorted({x for s, e, *_ in spans for x in (s, e)})
    index = {x: i for i, x in enumerate(edges)}
    n = len(edges)
    alpha, beta = [0.0] * n, [0.0] * n
    ending, starting = defaultdict(list), defaultdict(list)
    for i, (s, e, *_) in enumerate(spans):
        ending[index[e]].append(i)
        starting[index[s]].append(i)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for k in range(1, n):
        alpha[k] = alpha[k - 1]
        for i in ending[k]:
            alpha[k] = add(alpha[k], alpha[index[spans[i][0]]] + scores[i])
    for k in range(n - 2, -1, -1):
        beta[k] = beta[k + 1]
        for i in starting[k]:
            beta[k] = add(beta[k], beta[index[spans[i][1]]] + scores[i])
    return [math.exp(min(0.0, alpha[index[s]] + scores[i] + beta[index[e]] - alpha[-1])) for i, (s, e, *_) in enumerate(spans)]


def train(lines: list[tuple[str, set[tuple[str, int, int]]]], epochs: int = 8, rate: float = 0.4, decay: float = 1e-4) -> Model:
    """Weights by stochastic gradient ascent (AdaGrad) on the conditional likelihood."""
    model, sums = Model(), defaultdict(float)
    made = []
    for text, gold in lines:
        spans = proposals(text)
        made.append((spans, all_features(text, spans), [(x[2], x[0], x[1]) in gold for x in spans]))
    rng = random.Random(7)
    w = model.weights
    for _ in range(epochs):
        rng.shuffle(made)
        for spans, feats, gold in made:
            if not spans:
                continue
            p = _marginals(spans, [model.score(f) for f in feats])
            for fs, q, y in zip(feats, p, gold):
                g = y - q
                if abs(g) < 1e-4:
                    continue
                for f in fs:
                    gf = g - decay * w.get(f, 0.0)
                    sums[f] += gf * gf
                    w[f] = w.get(f, 0.0) + rate * gf / math.sqrt(sums[f] + 1e-8)
    return model


@cache
def trained(lines: int = SAMPLE_LINES) -> Model:
    from .personal_sample import sample_lines

    return train(sample_lines(lines))


def _search(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, starts, ends = [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for kind, s, e in model.find(text):
                    ids.append(doc_id)
                    kinds.append(kind)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "kind", "span_start", "span_end"])

    return run


def personal_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Spans (doc_id, kind, span_start, span_end) of personal data in ``docs`` (doc_id, text).

    Offsets are 0-based, half-open, in code points. Null ids and texts give nothing.
    """
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(_search(model or trained()), "doc_id long, kind string, span_start int, span_end int")


def _replace(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                if text is not None:
                    for kind, s, e in reversed(model.find(text)):
                        text = f"{text[:s]}[{kind}]{text[e:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "clean_text"])

    return run


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` as (doc_id, clean_text) with every found span replaced by its kind in brackets; null stays null."""
    return docs.select("doc_id", "text").mapInArrow(_replace(model or trained()), "doc_id long, clean_text string")
