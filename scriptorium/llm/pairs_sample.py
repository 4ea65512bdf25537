"""A small labelled sample of question and answer pairs, on which the cutoffs of the label models are validated.

The pairs are written here, from general knowledge and in several languages; none is taken from a table.
"""

from __future__ import annotations

# Questions with two whole answers each.
WHOLE = (
    ("zh", "长城是什么时候修建的？", "长城的修建始于春秋战国时期，后来秦朝把各段连接起来。明朝又大规模重修。", "它不是一次建成的。从公元前七世纪起，各国陆续筑墙。"),
    ("zh", "为什么海水是咸的？", "雨水把岩石里的盐分带进河流，再汇入海洋。水会蒸发，盐却留了下来。", "因为海水里溶有大量氯化钠。"),
    ("zh", "怎样煮一锅米饭？", "步骤如下：\n1. 淘米两次\n2. 加入等量的水\n3. 煮十五分钟", "米和水按一比一点二放入锅中，盖上盖子煮熟即可。"),
    ("zh", "谁写了《红楼梦》？", "一般认为前八十回是曹雪芹写的。", "作者是曹雪芹，后四十回常归于高鹗。"),
    ("en", "Why do leaves change colour in autumn?", "The tree stops making chlorophyll, so the green fades. Other pigments that were there all along become visible.", "Because the days grow shorter and the green pigment breaks down."),
    ("en", "Who painted the Mona Lisa?", "It was painted by Leonardo da Vinci.", "Leonardo da Vinci painted it in the early sixteenth century."),
    ("en", "How do I boil an egg?", "Here is how:\n- Bring water to the boil\n- Add the egg\n- Wait seven minutes", "Put the egg into boiling water and wait for about seven minutes."),
    ("en", "What is the capital of Australia?", "The capital of Australia is Canberra.", "Canberra. It was chosen as a compromise between Sydney and Melbourne."),
    ("ja", "富士山の高さはどれくらいですか？", "富士山の高さは約3776メートルです。日本で一番高い山です。", "標高は3776メートルです。"),
    ("ja", "桜はいつ咲きますか？", "東京では三月の終わりに咲き始めます。", "地域によりますが、だいたい三月から五月の間です。"),
    ("fr", "Quelle est la plus longue rivière de France ?", "La Loire est le plus long fleuve de France.", "C'est la Loire, qui est longue de mille kilomètres."),
    ("de", "Wie weit ist der Mond von der Erde entfernt?", "Der Mond ist im Mittel etwa 384.000 Kilometer von der Erde entfernt.", "Es sind rund 384.000 Kilometer, aber die Bahn ist nicht ganz rund."),
    ("es", "¿Quién escribió Don Quijote?", "La novela fue escrita por Miguel de Cervantes.", "Miguel de Cervantes es el autor de la obra."),
)
# Ways to decline.
DECLINED = {
    "zh": ("抱歉，我无法回答这个问题。", "这个话题我们还是不聊了吧。", "对不起，这超出了我能提供的范围，请换一个问题。", "恕我不能就此发表意见，谢谢理解。"),
    "en": ("I'm sorry, but I can't help with that.", "I'd prefer not to talk about this.", "I must respectfully pass on that one.", "Unfortunately I am not able to answer. Please ask something else."),
    "ja": ("申し訳ありませんが、お答えできません。", "その件については回答を控えさせていただきます。"),
    "fr": ("Je ne peux pas répondre à cette question.",),
    "de": ("Dazu möchte ich lieber nicht antworten.",),
    "es": ("Lo siento, no puedo responder a eso.",),
}
# Answers that only look like a refusal.
NOT_DECLINED = {
    "zh": "守卫说“我不能让你过去”，旅人于是绕道而行，三天后才到达城里。",
    "en": "The guard said “I can't let you pass”, so the traveller went around the hill and reached the town after three days.",
}
NOTHING = ("", "  \n", "​　", " ⁠")


def sample_pairs() -> list[tuple[str, str, str, frozenset[str]]]:
    """(question, answer, status, labels) of the sample."""
    out: list[tuple[str, str, str, frozenset[str]]] = []

    def add(q: str, a: str, *labels: str, status: str = "completed") -> None:
        out.append((q, a, status, frozenset(labels)))

    for i, (lang, q, first, second) in enumerate(WHOLE):
        for answer in (first, second):
            add(q, answer)
            add(q, answer + " [E1]", status="incomplete")
            for share in (0.45, 0.7):
                cut = answer[: max(6, int(len(answer) * share))].rstrip("。.!?！？ \n")
                if "\n" not in answer and cut != answer.rstrip("。."):
                    add(q, cut, "truncated", status="incomplete" if share > 0.5 else "completed")
        add(q, NOTHING[i % len(NOTHING)], "empty")
        for answer in (q, q + "\n" + q, "Question: " + q if lang != "zh" else "您的问题是：" + q, q.rstrip("?？ ") + "……"):
            add(q, answer, "echo")
        for answer in DECLINED[lang]:
            add(q, answer, "refusal")
        if lang in NOT_DECLINED:
            add(q, NOT_DECLINED[lang])
        for other, _, answer, _ in WHOLE:
            if other != lang and "\n" not in answer:
                add(q, answer, "wrong_language")
    add("请用英语回答：谁写了《红楼梦》？", "It was written by Cao Xueqin in the eighteenth century.")
    add("Translate into Chinese: the capital is Canberra.", "首都是堪培拉。")
    return out
