"""Telling prose from lists, tables, logs, settings and junk by statistics of the text.

Method: a text is cut at blank lines into blocks. Each block has two distributions, of its characters
over character classes and of its words over word classes (function words of each language, other
words by shape). They are compared by Jensen-Shannon divergence with the profiles of prose in each
language and of the other structures, and the block takes the nearest profile. A text is prose when
most of its characters are in blocks of prose. Basic counts are given alongside.

The profiles are the distributions of the example texts in EXAMPLES, computed by the same code when
a process starts; nothing is fitted to a corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The commonest words of each language that carry grammar rather than content.
FUNCTION_WORDS = {
    "en": """a about after all an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it
    its many may more most must my no nobody none nor not of on once one only or other our out over she should since so some than that the their them then there
    these they this those through to too two under up us was we were what when where which while who why will with would yet you your""",
    "de": """aber alle als also am an auch auf aus bei beim bis das dass dem den der des die dies diese doch durch ein eine einem einen einer er es für gegen gibt
    hat haben ich ihr im in ist kann kein keine man mehr mit nach nicht noch nur ob oder ohne schon sein seit sich sie sind so trotzdem über um und uns unter vom
    von vor war warum was weil wenn werden wie wir wird zu zum zur zwischen""",
    "fr": """au aux avec avant ce ces cette comme dans de des donc du elle elles en est et être eux il ils je la le les leur leurs lui mais même ne nous on ou où
    par pas plus pour pourquoi qu que qui quand sa sans se ses si son sont sous sur tous tout une un vous y à était déjà étaient après chaque""",
    "es": """al algo ante antes aunque como con cual cuando de del desde donde el ella ellos en entre era es esa ese eso esos esta este esto está están fue ha hasta
    hay la las le lo los más muy no nos o para pero por porque qué que se según ser si sin sino sobre son su sus también todo un una uno y ya después""",
}
LANGUAGES = tuple(FUNCTION_WORDS)

#: Texts of each structure. A profile is what they have in common, so each holds several kinds of it.
EXAMPLES = {
    "prose-en": """The boy had gone to the market with his two sisters, but none of them could say why it was closed. We were told that the baker, who had lived there for 30
years, must have left in the night! Is there any other shop that would sell us bread before the train comes? I don't think so; it is too late for that.
When you open the window in the morning, most of the birds that sing in the garden are already there. If a letter has come, put it on the table and leave it.""",
    "prose-de": """Der Junge war mit seinen Schwestern auf den Markt gegangen, aber keiner von ihnen konnte sagen, warum er geschlossen war. Wir haben gehört, dass der Bäcker
in der Nacht das Dorf verlassen hat, weil er seit 30 Jahren nicht mehr schläft. Gibt es noch einen anderen Laden, der uns Brot verkauft? Das ist nicht
sicher, und für heute ist es auch zu spät. Wenn man am Morgen das Fenster öffnet, sind die meisten Vögel schon da.""",
    "prose-fr": """Le garçon était allé au marché avec ses deux sœurs, mais aucune d'elles ne savait pourquoi il était fermé. On nous a dit que le boulanger, qui vivait là
depuis 30 ans, est parti dans la nuit. Est-ce qu'il y a un autre magasin où l'on vend du pain avant le départ du train ? Ce n'est pas sûr, et pour cette
raison nous sommes restés à la maison. Quand on ouvre la fenêtre le matin, les oiseaux sont déjà là.""",
    "prose-es": """El niño fue al mercado con sus dos hermanas, pero ninguna de ellas sabía por qué estaba cerrado. Nos han dicho que el panadero, que vivía allí desde hace
30 años, se fue por la noche. ¿Hay otra tienda en la que se venda pan antes de que salga el tren? Esto no es seguro, y para hoy ya es tarde. Cuando se
abre la ventana por la mañana, los pájaros ya están en el jardín, como se dijo.""",
    "prose-ja": """男の子は二人の姉と一緒に市場へ行きましたが、なぜ閉まっているのか、誰にも分かりませんでした。三十年前からそこに住んでいたパン屋は、夜のうちに
町を出たそうです。汽車が来る前に、パンを売っている店はほかにありますか。それは難しいので、今日は家にいることにします。朝、窓を開けると、庭の鳥はもう鳴いています。""",
    "list-marked": """- bread
- two apples
- Market street, old house
* Fresh milk
1. Garden tools
2) Winter coats
3. Paper
[ ] call the baker
[x] close window
• morning train tickets
+ blue paint
– rote Türen""",
    "list-plain": """bread
Market street
old houses
Garden tools
rote Türen
vieux journal
Winter coats
alte Briefe""",
    "list-inline": """bread; apples; market street; garden; blue paint; winter coat; window; letters
Kleine Häuser, neue Wagen, Garten, rote Türen, Fenster, alte Briefe, Bäcker
Home » About » Contact » Imprint » Login » Search
bread | Apples | market street | garden | blue paint""",
    "list-contents": """Chapter one ............ 3
Old houses ......................... 17
Garden ................ 24
Winter coats ............ 31""",
    "list-links": """https://shop.example/bread/fresh
https://shop.example/garden/tools
http://maps.example/street/old""",
    "list-changes": """## 2.1.0
- Add search to garden page
- Fix bread order in shop
- Remove old paint
- Rename street in letters
## 2.2.0
- Speed up train in market""",
    "table-csv": """name,price,stock,city
bread,2.40,17,Paris
apple,0.35,220,Bonn
milk,1.15,8,2023-05-11""",
    "table-marks": """| name | price | day |
|---|---|---|
| bread | 2.40 | 2023-05-11 |
| apple | 0.35 | 2023-05-12 |
name;price;stock
bread;2.40;17
bread\t2.40\t17\tParis
apple\t0.35\t220\tBonn""",
    "table-spaced": """name      price    stock    city
bread     2.40     17       Paris
apple     0.35     220      Bonn""",
    "table-named": """--- Sheet: shop ---
name: bread, price: 2.40, stock: 17, city: Paris
name: apple, price: 0.35, stock: 220, city: 2023-05-11""",
    "log": """2023-05-11T08:14:02.117Z INFO [shop-3] order accepted id=1177 took=35ms
2023-05-11T08:14:03.502Z WARN [shop-1] slow reply from store id=1178 took=935ms
May 11 08:14:05 host7 cron[811]: job started pid=4411
10.0.3.17 - - [11/May/2023:08:14:06 +0000] "GET /bread HTTP/1.1" 200 5123
2023-05-11 08:14:07,001 ERROR db.pool:88 connection lost (timeout=30s) retry=2""",
    "settings-keys": """[server]
port = 8080
max_size = 0.75
log_path = "/var/log/shop"
debug = false
export PATH_ROOT=/opt/shop/bin""",
    "settings-tree": """shop:
  store_name: north
  item_limit: 250
  use_cache: true
items[0].id: 4471
items[0].name: bread
items[0].price: 2.40
items[1].id: true""",
    "settings-header": """Subject: Re: old houses
From: baker@mail.example
To: market@mail.example
Date: 2023-05-11T08:14:02+00:00""",
    "junk-code": """9fK2mQzX7vLp0RtY4sWb8NcJ1hGd6aEo3iUx5TqVnM/BkZr+CyPwLjHfSgDaFeIuOO
Qx7+zLk2Pm9/RtYv0WbNc4JhGd8aEoK1iUxTqVnMBkZrCyPwLjHfSg==""",
    "junk-spaced": """T h e   b o y   h a d   g o n e   t o   t h e   m a r k e t   w i t h   h i s   t w o""",
    "junk-shuffled": """Teh yob dah gnoe to eth kemrat whti sih two sriesst, tub onen of tehm olucd sya hwy ti was slecodWe eerw dolt htat
eht aerbk, ohw dah idevl ereht for 30 sayer, smut aevh eflt in the gnithsI ehtre nay rohet phso taht owdul lels su read,b rofebe teh rtina
mocse I dno't nkthi so ti is oto etal rof thtaehWn uoy open eht wwiodn ni het gnirnom, somt fo the drbsi",
ttah gnis ni eht nedrag are laerady heert fI a tleter ash moce, upt it no the taleb""",
    "junk-keys": """q;w ,eir/ zx.c vbn k lj;h gfd ,sa po iu ty re.wq m nb vc xz/ l kj hg qow.eiru t;yal skdj fh,g""",
    "junk-syllables": """Lomu sari tefo nuvi bako. Dela fi ro gune mapi, su totu vika re. Peno la zibu tako me. Ga ruto vemi so pala ku dori.""",
    "junk-noise": """~¤%t#h*e §b|o^y¬ h@a=d <g>o%n#e ¤t|o * t^h~e m=a§r#k@e%t *w|i~t^h ¤h=i#s~ �t@w*o s%i|s<t=e>r^s""",
}
PROFILES = tuple(EXAMPLES)
PROSE = np.array([p.startswith("prose") for p in PROFILES])

#: Weight of a block's word distribution; the rest is the character classes'.
WORD_WEIGHT = 0.6
#: Least share of characters in blocks of prose; and how much nearer than prose another profile must be, as a
#: short sentence has few words to be told by.
PROSE_SHARE, MARGIN = 0.5, 0.025
#: Classes that every distribution gets this much of, so that one odd character cannot decide.
SMOOTH = 0.002

# Character classes and word classes, by number.
CHARS = ("lower", "upper", "digit", "space", "line end", "comma", "sentence end", "apostrophe", "hyphen", "colon", "separator", "bracket", "sign", "quote", "kana", "han", "symbol", "control")
WORDS = (*LANGUAGES, "lower", "title", "upper", "single", "number", "mixed", "kana run", "han run")
_CHAR_OF = {"\n": 4, ",": 5, "、": 5, ".": 6, "!": 6, "?": 6, "。": 6, "…": 6, "¿": 6, "¡": 6, "'": 7, "’": 7, "-": 8, "–": 8, "—": 8, ":": 9, ";": 10, "|": 10, "\t": 10, "/": 10, "\\": 10, "_": 12, "=": 12, "+": 12, "*": 12, "#": 12, "•": 12, "»": 12}
_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\n[ \t\r\f\v]*(?:\n[ \t\r\f\v]*)+")
_END = re.compile(r"[.!?…。！？:;\"”»)]$")
_NOTHING = "﻿\0"


@cache
def _char_classes() -> np.ndarray:
    """The class of every code point."""
    of = np.empty(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if 0x3040 <= c <= 0x30FF or 0xFF66 <= c <= 0xFF9F:
            of[c] = 14
        elif 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0x20000 <= c <= 0x3FFFF:
            of[c] = 15
        elif kind in ("Lu", "Lt"):
            of[c] = 1
        elif kind[0] in "LM":
            of[c] = 0
        elif kind[0] == "N":
            of[c] = 2
        elif kind[0] == "Z" or c == 13:
            of[c] = 3
        elif kind[0] == "C":
            of[c] = 17
        else:
            of[c] = 11 if kind in ("Ps", "Pe") else 13 if kind in ("Pi", "Pf") or c == 34 else 16
    for x, k in _CHAR_OF.items():
        of[ord(x)] = k
    return of


@cache
def _function_words() -> dict[str, tuple[int, ...]]:
    """The languages (by number) that use a word for grammar."""
    of: dict[str, tuple[int, ...]] = {}
    for k, name in enumerate(LANGUAGES):
        for w in FUNCTION_WORDS[name].split():
            of[w] = (*of.get(w, ()), k)
    return of


def _shape(word: str) -> int:
    """The class of a word that is no function word."""
    k = len(LANGUAGES)
    if "぀" <= word[0] <= "鿿" or "豈" <= word[0] <= "﫿":
        return k + 6 if any("぀" <= c <= "ヿ" for c in word) else k + 7
    if len(word) == 1:
        return k + 3 if word.isalpha() else k + 4
    if word.isalpha():
        return k if word.islower() else k + 1 if word.istitle() else k + 2 if word.isupper() else k + 5
    return k + 4 if word.isdecimal() else k + 5


def distributions(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, words): the counts of each block by class. A word of several languages counts in equal parts."""
    n = len(blocks)
    whole = "".join(blocks)
    codes = _char_classes()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    of_char = np.repeat(np.arange(n), [len(b) for b in blocks])
    chars = np.bincount(of_char * len(CHARS) + codes, minlength=n * len(CHARS)).reshape(n, len(CHARS))
    known, memo = _function_words(), {}
    at, classes, parts = [], [], []
    for i, b in enumerate(blocks):
        for w in _WORD.findall(b):
            if (c := memo.get(w)) is None:
                c = memo[w] = known.get(w.lower()) or (_shape(w),)
            for k in c:
                at.append(i)
                classes.append(k)
                parts.append(1 / len(c))
    words = np.bincount(np.array(at, np.int64) * len(WORDS) + np.array(classes, np.int64), parts, n * len(WORDS)).reshape(n, len(WORDS))
    return chars.astype(float), words


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``p`` from each row of ``q``; 0 to 1."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-12)
    p = (p + SMOOTH) / (1 + SMOOTH * p.shape[1])
    q = q / np.maximum(q.sum(1, keepdims=True), 1e-12)
    q = (q + SMOOTH) / (1 + SMOOTH * q.shape[1])

    def entropy(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(x)).sum(-1)

    middle = (p[:, None, :] + q[None, :, :]) / 2
    return entropy(middle) - (entropy(p)[:, None] + entropy(q)[None, :]) / 2


@cache
def _profiles() -> tuple[np.ndarray, np.ndarray]:
    return distributions([EXAMPLES[p] for p in PROFILES])


def nearest_profiles(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(profile number, divergence) of each block."""
    chars, words = distributions(blocks)
    far = (1 - WORD_WEIGHT) * divergence(chars, _profiles()[0]) + WORD_WEIGHT * divergence(words, _profiles()[1])
    far[:, PROSE] -= MARGIN
    best = far.argmin(1)
    return best, far[np.arange(len(blocks)), best]


STATS = "words int, mean_word_length double, lines int, function_words double, symbols double, line_ends double, prose double, divergence double, structure string"


def statistics(texts: list[str | None]) -> list[tuple | None]:
    """The columns of STATS of each text, None for a null or blank one.

    ``function_words``, ``symbols``, ``line_ends`` and ``prose`` are shares of words, of characters, of
    lines that end in punctuation and of characters in blocks of prose; ``divergence`` is the mean
    distance of its blocks from their nearest profiles; ``structure`` is the profile with most of the text.
    """
    blocks, owner = [], []
    for i, t in enumerate(texts):
        for b in _BLANK.split((t or "").replace("\r\n", "\n").strip(_NOTHING)):
            if b := b.strip().strip(_NOTHING).strip():
                blocks.append(b)
                owner.append(i)
    out: list[tuple | None] = [None] * len(texts)
    if not blocks:
        return out
    kind, far = nearest_profiles(blocks)
    chars, words = distributions(blocks)
    owner, size = np.array(owner), np.array([len(b) for b in blocks])
    n, k = len(texts), len(PROFILES)
    total = np.bincount(owner, size, n)
    by_kind = np.bincount(owner * k + kind, size, n * k).reshape(n, k)
    count = np.zeros((n, 3))
    np.add.at(count, owner, np.stack([words.sum(1), words[:, : len(LANGUAGES)].sum(1), chars[:, 5:14].sum(1) + chars[:, 16]], 1))
    letters = np.bincount(owner, chars[:, [0, 1, 2, 14, 15]].sum(1), n)
    away = np.bincount(owner, far * size, n)
    lines = [x for b in blocks for x in b.splitlines() if x.strip()]
    in_block = np.repeat(np.arange(len(blocks)), [sum(1 for x in b.splitlines() if x.strip()) for b in blocks])
    n_lines = np.bincount(owner[in_block], minlength=n)
    ends = np.bincount(owner[in_block], [bool(_END.search(x.rstrip())) for x in lines], n)
    for i in np.nonzero(total)[0]:
        w, f, s = count[i]
        out[i] = (int(round(w)), letters[i] / max(1, w), int(n_lines[i]), f / max(1, w), s / total[i], ends[i] / max(1, n_lines[i]), by_kind[i][PROSE].sum() / total[i], away[i] / total[i], PROFILES[by_kind[i].argmax()].partition("-")[0])
    return out


def prose_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, the columns of STATS) of every document other than code, whole texts.

    Null, empty and blank texts have no row (a byte order mark or NUL is nothing too); a null
    content_type counts as other than code. Repeated rows stay. Other columns are ignored. One map
    stage, no shuffle.
    """
    names = [x.split()[0] for x in STATS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int32(), *[pa.float64()] * 5, pa.string()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(ids), 256):  # a few texts at a time: their code points take 4 bytes each
                found = statistics(texts.slice(i, 256).to_pylist())
                rows = [(d, *s) for d, s in zip(ids[i : i + 256], found, strict=True) if s]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["doc_id", *names])

    other = documents.where(F.coalesce(F.col("content_type") != "code", F.lit(True)) & F.col("text").isNotNull())
    return other.select("doc_id", "text").mapInArrow(measure, f"doc_id bigint, {STATS}")


def not_prose(documents: DataFrame) -> DataFrame:
    """The rows of :func:`prose_statistics` whose text as a whole is no prose."""
    return prose_statistics(documents).where(F.col("prose") < PROSE_SHARE)
