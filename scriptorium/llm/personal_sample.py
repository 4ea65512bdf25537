"""Labelled lines for the training of the personal-data model, composed at random from general parts.

A line is put together from labels, separators, verbs and values of public formats, in several
shapes (labelled fields, lists in brackets, signatures, prose), between sentences with invented
names and numbers that are no personal data. Shapes are numbered so that some can be withheld from
training, which measures what the model makes of unseen ones.
"""

from __future__ import annotations

import random

from .personal import COMPOUND, FIRST_NAMES, GIVEN, JAPANESE, SURNAMES, TRANSLIT

Gold = set[tuple[str, int, int]]

# Labels, verbs and words of the composed lines.
LABELS = {
    "zh": {
        "NAME": "姓名 名字 联系人 负责人 收件人 收货人 寄件人 申请人 作者 译者 编辑 校订 署名 签名 投稿人 户主 客户".split(), "PHONE": "电话 手机 手机号 联系电话 联系方式 热线 固话 号码".split(),
        "EMAIL": "邮箱 电邮 电子邮箱 邮件 Email E-mail".split(), "ADDRESS": "地址 住址 家庭住址 收货地址 通讯地址 办公地点".split(), "ID_NUMBER": "身份证 身份证号 身份证号码 证件号码 公民身份号码".split(),
    },
    "en": {
        "NAME": "Name|Full name|Contact|Recipient|Author|Editor|Translator|Customer|Account holder|Attn".split("|"), "PHONE": "Phone|Tel|Mobile|Cell|Telephone|Call".split("|"), "EMAIL": "Email|E-mail|Mail|Contact".split("|"),
        "ADDRESS": "Address|Home address|Ship to|Deliver to|Residence".split("|"), "ID_NUMBER": "SSN|Social Security Number|ID|ID number|Tax ID".split("|"),
    },
    "ja": {"NAME": "氏名 お名前 名前 担当 連絡先".split(), "PHONE": "電話 電話番号 携帯".split(), "EMAIL": "メール 連絡先".split(), "ADDRESS": "住所".split(), "ID_NUMBER": "番号".split()},
}
SEPARATORS = {"zh": "：|:|: |｜|＝|——|，|是|为| |\t".split("|"), "en": ": |:| - | = | is |, |\t".split("|"), "ja": "：|: |は".split("|")}
NUMBER_LABELS = {"zh": "编号 序号 订单号 快递单号 库存编号 条码 版本号 流水 校验码 群号 账号 房间号 第".split(), "en": "Order|Item|Serial|Ref|Invoice|Ticket|Version|Checksum|Part number|UID|Lot".split("|"), "ja": "品番 注文".split()}
TIMES = "今晚 昨夜 今早 今天 昨天 前天 上周 早上 下午 去年 方才 周末 夜里".split()
SAID = "在会上说 在电话里说 在论坛上说 在信里写道 在微信里说 说 写道 提醒大家 告诉我 留言说 来电说 补充道 在会上说 回信说 问".split()
CALMLY = "悄悄 慢慢 终于 再次 匆匆 独自 一同 默默".split()
DID = "走过 离开 守着 打开 带回 修好 看见 寻找 画下 埋藏".split()
#: Common words that begin like a surname.
COMMON = "黎明 温柔 高兴 白云 金光 江水 安静 方才 成为 任何 于是 常常 万里 石头 水井 马车 黄昏 明白 时候 平安 康复 章节 毕竟 连同 齐全 古老 钟声 田野 雷电 严重 温暖 林间 叶子 阳光 关于 包括 单独 高山 白雪 金色 江湖 和平 何时 何处 花瓣 文字 童年 温泉 安然 常青 丰收 方向 石桥 白昼 夏天 秋风 冬雪 顾客 闻名 温度 祁连 路人 路边 季节 陆地 谷雨 莫非 严寒 汤药 麦子 苗圃 费力 解开 强大 单调 柏树 霍然 曲调 成果 计划 经书 余光 余下 凌晨 乐曲 康宁 易碎 武器 贺礼 赖以 龙船 段落 传闻 闻言 文章 文稿 石像 于今 冬至 夏至 章法 金属 白天 水面 温和".split()
ADVERBS = "忽然 欣然 悠然 坦然 慨然 默然 依旧 从此 仍然 渐渐 骤然".split()
THINGS = "灯笼 木船 钥匙 铜钟 地图 斗篷 山谷 石碑 水井 花园 旧书 长剑 麦田 城墙 港口 雪原".split()
EN_THINGS = "lamp river gate bridge mirror garden hammer market cellar forest needle painting wagon mill".split()
EN_DID = "crossed guarded painted repaired opened carried visited followed hid remembered".split()
CLOSINGS = {"zh": ("此致", "敬上，", "谢谢，", "祝好，", "顺颂时祺，"), "en": ("Regards,", "Best regards,", "Sincerely,", "Yours truly,", "Thanks,", "Signed,", "Cheers,"), "ja": ("敬具",)}


class Writer:
    """One random composer of values and lines."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def one(self, xs):
        return self.rng.choice(list(xs)) if not isinstance(xs, (list, tuple, str)) else self.rng.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def han(self, n: int) -> str:
        return "".join(chr(self.rng.randint(0x4E00, 0x9F00)) if self.rng.random() < 0.3 else self.rng.choice(GIVEN + "山石水云东西南北中新和平安康古松桥柳河泉") for _ in range(n))

    def invented(self) -> str:
        """A made-up western word of two or three syllables."""
        start, mid, end = "B Br C Cl D Dr F G H K L M N P R S Sh T Th V W".split(), "a e i o u ar en il or ai".split(), "bert don field ford ley mond more nard ric sen son ston ton vale well worth ia ina elle".split()
        return self.one(start) + self.one(mid) + (self.one("b d g l m n r s t v".split()) + self.one(mid) if self.rng.random() < 0.4 else "") + self.one(end)

    def name(self, lang: str) -> str:
        r = self.rng.random()
        if lang == "zh":
            first = self.one(COMPOUND) if r < 0.04 else self.one(SURNAMES)
            return first + "".join(chr(self.rng.randint(0x4E00, 0x9F00)) if self.rng.random() < 0.35 else self.one(GIVEN) for _ in range(self.one([1, 2, 2])))
        if lang == "ja":
            return self.one(JAPANESE) + self.one(["", " "]) + self.one(["太郎", "花子", "健", "美咲", "翔太", "さくら", "一郎", "直樹", "陽子"])
        first = self.one(sorted(FIRST_NAMES)) if r < 0.4 else self.invented()
        middle = f" {self.one('ABCDEFGHJKLMPRSTW')}." if self.rng.random() < 0.25 else ""
        return f"{first}{middle} {self.invented()}"

    def figure(self, lang: str) -> str:
        """A figure of a story: no person."""
        if lang == "zh":
            return "".join(self.one(TRANSLIT) for _ in range(self.one([2, 3, 3, 4])))
        if lang == "ja":
            return "".join(self.one("アイウカキクサシスタテトナニノマミムラリル") for _ in range(self.one([3, 4])))
        return self.invented() + self.one(["", "", " " + self.invented(), " the Elder"])

    def begun(self) -> str:
        """A thing or any other word that begins like a surname."""
        return self.one([self.one(THINGS), self.one(COMMON), self.one(SURNAMES) + chr(self.rng.randint(0x4E00, 0x9F00))])

    def phone(self, lang: str) -> str:
        r = self.rng.random()
        if lang == "zh":
            head, sep = "1" + self.one("3456789") + self.digits(1), self.one(["", "", " ", "-"])
            number = f"{head}{sep}{self.digits(4)}{sep}{self.digits(4)}"
            if r < 0.2:
                return f"0{self.digits(self.one([2, 3]))}-{self.digits(self.one([7, 8]))}" + self.one(["", "", f"转{self.digits(3)}"])
            if r < 0.3:
                return (head + self.digits(8)).translate(str.maketrans("0123456789", "０１２３４５６７８９"))
            return self.one(["+86 ", "+86-", "+86", "", "", "", ""]) + number
        if lang == "ja":
            return self.one([f"0{self.digits(1)}-{self.digits(4)}-{self.digits(4)}", f"+81 {self.digits(2)} {self.digits(4)} {self.digits(4)}"])
        sep = self.one("-. ")
        tail = f" ext. {self.digits(2)}" if self.rng.random() < 0.15 else f" x{self.digits(3)}" if self.rng.random() < 0.05 else ""
        if r < 0.15:
            return f"0{self.digits(self.one([2, 3]))} {self.digits(4)} {self.digits(4)}"
        if r < 0.25:
            return f"+{self.one(['44', '49', '33', '61'])} {self.digits(2)} {self.digits(4)} {self.digits(4)}"
        return self.one([f"({self.digits(3)}) {self.digits(3)}-{self.digits(4)}", f"{self.digits(3)}{sep}{self.digits(3)}{sep}{self.digits(4)}", f"+1 {self.digits(3)} {self.digits(3)} {self.digits(4)}", f"+1-{self.digits(3)}-{self.digits(3)}-{self.digits(4)}"]) + tail

    def identity(self, lang: str) -> str:
        if lang == "en":
            sep = self.one("--  ")
            return f"{self.digits(3)}{sep}{self.digits(2)}{sep}{self.digits(4)}"
        sep = self.one(["", "", "", " ", "-"])
        return f"{self.digits(6)}{sep}{self.rng.randint(1930, 2012)}{self.rng.randint(1, 12):02d}{self.rng.randint(1, 28):02d}{sep}{self.digits(3)}{self.one('0123456789Xx')}"

    def email(self) -> str:
        a, b = self.invented(), self.invented()
        local = self.one([f"{a}.{b}", f"{a}{self.digits(2)}", f"{a}_{b}", f"{a[0]}{b}", f"{a}-{b}", f"{a}+{b}"])
        local = self.one([local, local.lower(), local.lower(), local.lower()])
        domain = self.one(["gmail.com", "example.com", "mail.example.org", "uni.example.edu", "firm.co", "qq.com", "163.com", "post.example.net"])
        r = self.rng.random()
        if r < 0.08:
            return f"{local}(at){domain}"
        if r < 0.16:
            return f"{local} [at] {domain.replace('.', ' [dot] ')}"
        address = f"{local}@{domain}"
        return address.upper() if r < 0.24 else address.replace("@", "＠") if r < 0.32 else address

    def address(self, lang: str) -> str:
        if lang == "en":
            unit = self.one(["", "", f", Apt {self.digits(2)}", f", Flat {self.digits(1)}", f", Unit {self.digits(1)}B", f" Suite {self.digits(3)}"])
            town = self.one(["", f", {self.invented()}", f", {self.invented()}"])
            number = str(self.rng.randint(1, 9999)) + self.one(["", "", "", "A", "B"])
            return f"{number} {self.one([self.invented(), 'Oak', 'Church', 'Mill', 'High', 'Baker', 'Station'])} {self.one(['Street', 'Road', 'Lane', 'Close', 'Ave.', 'Drive', 'Avenue', 'Court', 'Square'])}{unit}{town}"
        city = self.one(["", "", f"{self.han(2)}市"])
        unit = self.one(["", f"{self.rng.randint(1, 20)}栋{self.rng.randint(100, 1800)}室", f"{self.rng.randint(1, 9)}单元{self.rng.randint(100, 900)}室", f"{self.rng.randint(1, 9)}号楼", f"{self.rng.randint(2, 30)}楼"])
        return f"{city}{self.han(2)}{self.one('区区县')}{self.han(2)}{self.one(['路', '街', '巷', '大道'])}{self.rng.randint(1, 800)}号{unit}"

    def value(self, kind: str, lang: str) -> str:
        if kind == "EMAIL":
            return self.email()
        if kind == "ADDRESS" and lang == "ja":
            lang = "zh"
        return {"NAME": self.name, "PHONE": self.phone, "ID_NUMBER": self.identity, "ADDRESS": self.address}[kind](lang)

    def filler(self, lang: str) -> list:
        """A sentence without personal data."""
        f = lambda: self.figure(lang)
        if lang == "zh":
            t = lambda: self.one(THINGS)
            return [self.one([
                f"{f()}{self.one(CALMLY)}{self.one(DID)}{self.digits(2)}座{t()}，{f()}{self.one(DID)}{t()}。", f"{self.one(TIMES)}，{f()}与{f()}{self.one(CALMLY)}{self.one(DID)}{t()}。", f"{f()}说：“{t()}和{t()}都属于{f()}。”",
                f"有人{self.one(DID)}了{self.han(2)}城的{t()}，{f()}却{self.one(DID)}{t()}。", f"{self.one(NUMBER_LABELS['zh'])}{self.one(['', '：', ' '])}{self.digits(self.one([6, 9, 11, 12, 13, 17, 18, 20]))}的{t()}已经{self.one(DID)}。",
                f"{self.one(THINGS)}在{self.han(2)}的{t()}旁，{t()}{self.one(CALMLY)}等待{f()}。", f"版本 {self.digits(1)}.{self.digits(1)}.{self.digits(3)}，发布于 20{self.digits(2)}-0{self.one('123456789')}-1{self.digits(1)}。", f"关注 @{self.invented()}_{self.digits(2)} 获取{t()}。",
                f"\n# {self.han(2)}{self.one('谷关渡桥原岭湾')}{t()}\n", f"{self.one(COMMON)}{f()}曾以{t()}{self.one(DID)}{t()}，{self.one(COMMON)}{self.one('由在与和')}{f()}{self.one(DID)}。",
                f"{self.one(COMMON)}的{t()}{self.one(['与', '和', '、', '，'])}{self.one(COMMON)}的{t()}一同{self.one(DID)}。", f"{f()}不知为何{self.one(ADVERBS)}{self.one(DID)}{t()}，{self.one(['只留下', '把', '与', '和', '对', '在'])}{self.one(COMMON)}{t()}。", f"{f()}：{self.one(COMMON)}{self.one(['，', '的', '又', '在', ''])}{t()}，{f()}与{f()}{self.one(ADVERBS)}{self.one(DID)}。",
                f"{self.one(['我', '他', '她', '我们'])}{self.one(['和', '与', '跟'])}{f()}一起{self.one(DID)}{t()}。", f"{f()}{self.one(['说', '叫', '让', '请', '由'])}{self.one(['', self.one(ADVERBS)])}{f()}{self.one(DID)}{self.one(COMMON)}。",
                f"{f()}由{f()}{self.one(DID)}，{f()}把{t()}交给{f()}，{self.han(2)}镇{self.one(DID)}{self.han(3)}。",
                f"{self.one(TIMES)}，{f()}的{t()}{self.one('与和及、')}{self.begun()}{self.one(['一同', '一起', '都', '也', ''])}{self.one(['被', '由', '给', '让'])}{f()}{self.one(DID)}。", f"{f()}{self.one(DID)}{self.one(['', '了'])}{self.begun()}{self.one('，；。…')}{self.begun()}{self.one(['', '的'])}{self.one(DID)}{t()}，{self.one(['只', '却把', '都', '也'])}{self.begun()}{self.one(['', '的'])}{t()}。",
            ])]
        if lang == "ja":
            return [self.one([f"{f()}は{self.digits(2)}の塔を見つめたのです。", "しずかな海が町をつつんだ。", f"{f()}と{f()}が橋をわたる。"])]
        w = lambda: self.one(EN_THINGS)
        return [self.one([
            f"{f()} {self.one(EN_DID)} the {w()} before {f()} {self.one(EN_DID)} it. ", f"The old {w()} near {f()} was {self.one(EN_DID)} by {f()}. ", f"{self.one(NUMBER_LABELS['en'])} {self.digits(self.one([5, 9, 10, 11, 12, 16]))} weighs {self.digits(2)} units. ",
            f"“Leave the {w()},” said {f()}, “because {f()} is gone.” ", f"Follow @{self.invented()}_{self.digits(1)} for {w()} news. ", f"After {f()} {self.one(EN_DID)} the {w()}, {f()} {self.one(EN_DID)} {self.digits(3)} {w()}s from {f()}. ",
            f"Version {self.digits(1)}.{self.digits(2)}.{self.digits(3)}, checksum {self.rng.getrandbits(64):016x}, {self.one(NUMBER_LABELS['en'])} {self.digits(9)}. ", f"When the {w()} fell, {f()} of {f()} {self.one(EN_DID)} the {w()}. ",
        ])]

    def prose(self, lang: str, shape: int) -> list:
        """A sentence with personal data; every slot is a pair (kind,)."""
        n, p, m, a, i = ("NAME",), ("PHONE",), ("EMAIL",), ("ADDRESS",), ("ID_NUMBER",)
        if lang == "zh":
            say, t = self.one(SAID), self.one(TIMES)
            return [
                [t, n, say, "，", self.one(["资料", "文件", "相片", "答案"]), self.one(["请发到 ", "找 ", "可向 "]), m, self.one([" 索取。", "。", " 领取。"])], [self.one(["由", "请", "感谢", "谢谢"]), n, self.one(["和", "与", "、"]), n, self.one(["", "共同", "一起", "合作", "分别", "主要"]) + self.one(["负责", "帮忙", "编写", "审阅", "翻译", "完成", "制作", "录入", "修订"]), self.one(["。", "，来信寄 ", "，邮箱是 "]), *([m, "。"] if self.rng.random() < 0.5 else [])],
                [self.one(["我叫", "我是", "本人", "大家好，我叫"]), n, self.one(["，", "。"]), self.one(["电话 ", "可以打 ", "手机是", "联系我："]), p, self.one(["。", " 联系。", " 就好。"])], [self.one(["包裹", "礼物", "书", "信件"]), self.one(["请寄到", "送到", "发往", "寄至："]), a, self.one(["，", "，交给", "，联系人"]), n, self.one(["收。", "。", "，" ]), *(["电话", p, "。"] if self.rng.random() < 0.5 else [])],
                [self.one(["有事", "急事", "报名", "咨询"]), self.one(["请拨打 ", "致电 ", "打 ", "加手机 "]), p, self.one(["，", "或", "，也可以写到 "]), m, "。"], [n, self.one(TITLES_ZH := ["先生", "女士", "老师", "同学", "教授"]), self.one(["，您好，", "您好：", "，", "："]), self.one(["您的", "登记的", "留下的"]), self.one(["地址", "住址"]), a, self.one(["有误。", "已经登记。", "需要核对。"])],
                [n, self.one(["搬家了，新地址是", "现在住在", "已经搬到"]), a, self.one(["，电话也换成 ", "，打 ", "，新号码 "]), p, "。"], [self.one(["活动在", "地点：", "我们约在", "见面地点是"]), a, self.one(["，找", "，联系", "，负责人"]), n, self.one(["", *TITLES_ZH]), "。"],
                [self.one(["核对", "登记", "证件"]), self.one(["：", "信息："]), n, self.one(["，", " ", "，身份证"]), i, self.one(["。", "，请保密。", "，已通过。"])], ["我和", n, self.one(["一起", "在", "去"]), self.one(["吃饭。", "学校上课。", "爬山。"])], [self.one(["身份证", "身份证号是", "证件"]), i, self.one(["通过审核", "已登记", "的用户"]), "，", self.one(["预留手机", "电话", "号码"]), p, "。"],
                [self.one(["旧电话 ", "以前的号码 ", "原号 "]), p, self.one(["停机", "不用了", "作废"]), "，", *self.one([["请改打 "], [n, "改用 "], [n, "换了 "], [n, "的新号是 "], ["现在用 "], ["找", n, "请打 "]]), p, "。"], ["（", n, self.one(["，", "；", " "]), self.one([i, p, m]), self.one(["，", "；"]), a, "）"], [self.one(["译文", "本页", "攻略", "稿件"]), self.one(["校对", "整理", "作者"]), self.one(["：", "是"]), n, self.one(["（", "（邮箱 ", "，邮箱 "]), m, self.one(["）", "）。"])],
            ][shape]
        if lang == "ja":
            return [[self.one(["名前は", "私は", "担当は"]), n, self.one(["です。", "と申します。"]), self.one(["電話は", "連絡は"]), p, "。"], [n, self.one(["さん", "様"]), "に", self.one(["聞いてください。", "連絡しました。"])]][shape % 2]
        return [
            [self.one(["My name is ", "I am ", "This is "]), n, self.one([", reach me at ", "; phone me on ", " and my number is "]), p, self.one([". ", " after six. "])], [self.one(["Write to ", "Email ", "Reach us at ", "Send a note to "]), m, self.one([" or call ", " or dial ", " or text "]), p, ". "],
            [self.one(["Parcels go to ", "Please ship to ", "Mail it to ", "The party is at "]), a, self.one([", care of ", ", for ", "; ask for ", ", attn "]), n, ". "], [n, self.one([" has moved to ", " lives at ", " now works at "]), a, self.one([" and answers ", "; call ", ", phone "]), p, ". "],
            [self.one(["Edited by ", "Translated by ", "Written by ", "Checked by "]), n, " (", m, "). "], [self.one(["According to ", "As "]), n, self.one([" said in a mail from ", " told us from ", " explained via "]), m, ", the page is out of date. "], [self.one(["[", "("]), n, self.one(["; ", ", "]), self.one([i, p, m]), self.one(["; ", ", "]), a, self.one(["]", ")"])],
            [self.one(["The number ", "Social security number ", "SSN "]), i, self.one([" leaked, tell ", " should be removed, write ", " is shown here; contact "]), m, ". "], [self.one(["Ask for ", "Speak to ", "Please see ", "Dear "]), self.one(["Mr. ", "Ms. ", "Dr. ", "Mrs. "]), n, self.one([" at ", ", who lives at "]), a, ". "],
            [self.one(["Account of ", "Holder: ", "Registered to "]), n, self.one([", ID ", ", number ", ", SSN "]), i, ". "], [self.one(["My friend ", "Thanks to ", "We met ", "My colleague "]), n, self.one([" said hello. ", " for the help. ", " at the market. "])], [self.one(["The line ", "My former number ", "The old phone "]), p, self.one([" no longer works, ", " was cut off; "]), n, self.one([" is on ", " answers on "]), p, ". "],
            [self.one(["Call ", "Ring ", "Phone "]), p, self.one([" today. ", " now. ", " and wait. "])], [self.one(["I live at ", "Find us at ", "Our house is "]), a, ". "],
        ][shape]

    def fields(self, lang: str) -> list:
        kinds = self.rng.sample(["NAME", "PHONE", "EMAIL", "ADDRESS", "ID_NUMBER"], self.one([1, 2, 3, 3]))
        sep, between = self.one(SEPARATORS[lang]), self.one(["\n", "\n", "；" if lang != "en" else "; ", "，" if lang != "en" else ", "])
        out: list = []
        for k in kinds:
            out += [between] if out else []
            out += [self.one(LABELS[lang][k]), sep, (k,)]
        return [*out, self.one(["。", "", "\n"]) if lang != "en" else self.one([". ", "", "\n"])]

    def signature(self, lang: str) -> list:
        rest = self.rng.sample(["PHONE", "EMAIL", "ADDRESS"], self.one([0, 1, 2]))
        return ["\n", self.one(CLOSINGS[lang]), "\n", ("NAME",), *(x for k in rest for x in ("\n", (k,))), "\n"]


#: Numbers of prose shapes of each language.
SHAPES = {"zh": 14, "en": 14, "ja": 2}


def sample_lines(n: int, seed: int = 11, shapes: dict[str, list[int]] | None = None, plain: bool = True) -> list[tuple[str, Gold]]:
    """``n`` labelled texts (text, {(kind, start, end)}) of the given prose shapes (all if none), with fields and signatures if ``plain``."""
    w = Writer(seed)
    out = []
    for _ in range(n):
        lang = w.one(["zh", "zh", "zh", "en", "en", "ja"]) if plain else w.one(["zh", "en"])
        r = w.rng.random()
        allowed = (shapes or {}).get(lang, list(range(SHAPES[lang])))
        if not plain or r < 0.6:
            parts = w.prose(lang, w.one(allowed))
        else:
            parts = w.fields(lang) if r < 0.8 else w.signature(lang) if r < 0.88 else []
        gap = lambda: w.one(["", "", "\n", "\n\n"])
        around = lambda: [x for _ in range(w.one([0, 1, 2, 3])) for x in w.filler(lang if w.rng.random() < 0.8 else w.one(["zh", "en", "ja"]))]
        text, gold = "", set()
        before, after = around(), around()
        for part in [*before, gap(), *parts, gap(), *after]:
            if part and isinstance(part, str) and text[-1:].isascii() and text[-1:].isalnum() and part[:1].isascii() and part[:1].isalnum():
                text += " "
            if isinstance(part, tuple):
                if text[-1:].isascii() and text[-1:].isalnum():
                    text += " "
                value = w.value(part[0], lang)
                gold.add((part[0], len(text), len(text) + len(value)))
                text += value
            else:
                text += part
        out.append((text, gold))
    return out
