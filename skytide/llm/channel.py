"""A noisy channel for disguised words: restores what was meant before it is scored.

A writer's word passes through a channel that swaps letters for look-alikes (digits, signs, letters of other scripts),
masks them with stars, repeats them, spaces them out or puts signs between them. Every token becomes a lattice: per
position, the letters that could have been meant, with what each disguise costs. Viterbi decoding finds the cheapest path
under a character language model (trigrams with back-off, and less for words it knows) and the channel's costs together. Its
states hold all that a path's further cost depends on, and none is pruned, so the path found is the cheapest.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable

import regex

from skytide.llm.words import INVISIBLE

#: Signs and digits that stand for letters.
LEET = {
    "0": "o", "1": "il", "3": "eз", "4": "aч", "5": "s", "6": "gб", "7": "t", "8": "b", "9": "g", "@": "aа", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "2": "z",
}
#: Letters of one script that look like letters of another (Cyrillic and Greek, then Latin).
ALIKE = dict(zip("аеорсухіјѕһԁѵкмтвнαβεικνορτυχ", "aeopcyxijshdvkmtbhabeikvoptux"))
BACK: dict[str, str] = {}
for _c, _l in ALIKE.items():
    if "Ѐ" <= _c <= "ӿ":
        BACK.setdefault(_l, _c)
#: Costs (nats): a look-alike, a leet sign, a star for any letter, dropping a sign or a star, a run of repeats meant as one
#: or two, a pair meant as one (shared by the pairs of a token, as one pair is ordinary spelling), a word's end among spaced letters or at a sign, and letters written for another of the same sound.
COST = {"alike": 1.0, "leet": 0.7, "star": 1.0, "drop": 1.5, "unstar": 4.0, "one": 0.2, "two": 0.5, "pair": 6.0, "apart": 3.5, "sound": 2.0}
#: What a whole known word is worth (nats).
KNOWN = 5.0

MARK = "*#•_"
#: Things that pipelines leave inside words: entities, escapes, control tags.
DEBRIS = regex.compile(r"<\|[\w ]*\|>|\[[A-Z]{2,12}\]|&#?\w{1,8};|%[0-9A-Fa-f]{2}|[\p{So}\p{Sk}️﷽“”…]+")
SPACED = regex.compile(r"(?<![\p{L}\p{N}])[\p{L}\p{N}@$!*#](?:([ .\-_·,/])[\p{L}\p{N}@$!*#]){2,}(?![\p{L}\p{N}])")
TOKEN = regex.compile(r"[\p{L}\p{N}@$!|+€*#•_]+(?:['’][\p{L}]+)?")
RUN, PAIR = regex.compile(r"(.)\1+"), regex.compile(r"(\p{L})\1")
#: Words whose lattice has a single path: letters of one script, none twice in a row, and no ph.
ALONE = regex.compile(r"(?!.*(?:ph|(.)\1))(?:[a-zß-öø-ÿ]+|[а-яё]+|\p{Han}+)")
AMOUNT = regex.compile(r"\d+\p{L}{1,3}")  # 1st, 20kg
HAS_LETTER, SIGN, REPEATS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{N}]"), regex.compile(r"(\p{L})\1\1")
BROKEN = regex.compile(r"[ÐÑÃÂ][\x80-\xbf]|[åæçäèéï][\x80-\xbf]{2}")


class CharModel:
    """Character trigrams with back-off (interpolated), over words with their bounds."""

    def __init__(self, words: Iterable[str], weights: Iterable[float] | None = None):
        words = list(words)
        self.c = [Counter(), Counter(), Counter(), Counter()]
        weights = weights or iter(lambda: 1.0, None)
        for w, n in zip(words, weights):
            s = f"  {w} "
            for i in range(2, len(s)):
                self.c[1][s[i]] += n
                self.c[2][s[i - 1 : i + 1]] += n
                self.c[3][s[i - 2 : i + 1]] += n
                self.c[0][""] += n
        self.h2, self.h1 = Counter(), Counter()
        for k, n in self.c[3].items():
            self.h2[k[:2]] += n
        for k, n in self.c[2].items():
            self.h1[k[0]] += n
        self.words = frozenset(words)
        self.longest = max(map(len, self.words), default=0)
        #: A tree of the words' letters: per node its children; and which nodes are words of how many letters.
        self.tree: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        for w in self.words:
            n = 0
            for x in w:
                if x not in self.tree[n]:
                    self.tree[n][x] = len(self.tree)
                    self.tree.append({})
                n = self.tree[n][x]
            self.ends[n] = len(w)
        self.letters = sorted(x for x in self.c[1] if x != " ")
        self.follow: dict[str, list[str]] = {}
        for k in self.c[3]:
            self.follow.setdefault(k[:2], []).append(k[2])
        self.memo: dict[str, float] = {}

    def end(self, a: str, b: str, node: int) -> float:
        """Nats of a word's end after a and b; a word that the model knows (its node in the tree) costs less, above all from
        three letters on."""
        n = self.ends.get(node, 0)
        return self.cost(a, b, " ") - (KNOWN if n > 2 else KNOWN / 2 if n else 0.0)

    def cost(self, a: str, b: str, x: str) -> float:
        """Nats of x after a and b."""
        k = a + b + x
        if (v := self.memo.get(k)) is None:
            p = (self.c[1][x] + 0.05) / (self.c[0][""] + 10)
            p = (self.c[2][b + x] + 2 * p) / (self.h1[b] + 2)
            p = (self.c[3][k] + 1 * p) / (self.h2[a + b] + 1)
            v = self.memo[k] = -math.log(max(p, 1e-12))
        return v


def script(c: str) -> str:
    o = ord(c)
    return "c" if 0x400 <= o <= 0x52F else "g" if 0x370 <= o <= 0x3FF else "h" if o >= 0x2E80 else "l" if c.isalpha() else ""


def disguised(word: str) -> bool:
    """Whether a word of letters can't be one that a model should learn as known: three equal letters, or mixed scripts."""
    return bool(REPEATS.search(word)) or len({script(c) for c in word} - {"h"}) > 1


def mend(text: str) -> str:
    """Text whose UTF-8 was once read as a single-byte code, read again as UTF-8."""
    if not BROKEN.search(text):
        return text
    for code in ("latin-1", "cp1252"):
        try:
            return text.encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return text


def clean(text: str) -> str:
    """Compatibility form without debris and invisible characters; letters keep their case."""
    text = mend(text)
    if text.isascii():
        return DEBRIS.sub("", text) if "&" in text or "%" in text or "<" in text or "[" in text else text
    text = unicodedata.normalize("NFC", DEBRIS.sub("", text))
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


class Channel:
    """Restores texts with a character model."""

    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def restore(self, text: str) -> str:
        """The text as meant, in folded case."""
        text = SPACED.sub(lambda m: self._joined(m.group(0), m.group(1)), clean(text)).casefold()
        other = {t: r for t in set(TOKEN.findall(text)) if (r := self._token(t)) != t}
        return TOKEN.sub(lambda m: other.get(m.group(0), m.group(0)), text) if other else text

    def _joined(self, run: str, sep: str) -> str:
        letters = run.replace(sep, "") if sep in run[1::2] and len(set(run[1::2])) == 1 else run[::2]
        if not HAS_LETTER.search(letters) or len(letters) < 3:
            return run
        return self.decode(letters.casefold(), apart=True)

    def _token(self, token: str) -> str:
        """A token as meant. One that the model knows is meant as it is written, one without letters is no word, and neither
        is an amount. Letters and digits in a row that are too many for any known word, even if each repeat and each pair of
        letters stands for one, are none whatever path is taken (encoded data), and stay without looking for it."""
        if token in self.model.words or ALONE.fullmatch(token):
            return token
        core = token.rstrip("!")
        if core not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            word = not HAS_LETTER.search(core) or AMOUNT.fullmatch(core)
            longest = max(len(RUN.sub(r"\1", x)) for x in SIGN.split(core))
            self.known[core] = core if word or longest > 2 * self.model.longest else self.decode(core)
        return self.known[core] + token[len(core) :]

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Per position of a token the strings that could be meant (a letter, two, none, or a space) and their costs."""
        main = Counter(script(c) for c in token if c.isalpha())
        digits_only_latin = main and main.most_common(1)[0][0] or "l"
        # a word in Latin letters with some Cyrillic look-alikes is Latin, and the other way round
        cyr = [c for c in token if script(c) == "c"]
        target = "l" if main.get("l") and all(c in ALIKE for c in cyr) else digits_only_latin
        pair = COST["pair"] / max(len(PAIR.findall(token)), 1)
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            c = token[i]
            n = 1
            while i + n < len(token) and token[i + n] == c:
                n += 1
            i += n
            arcs: list[tuple[str, float]] = []
            if c in MARK:
                out += [[(x, COST["star"]) for x in self.model.letters if script(x) in (target, "")] + [("", COST["unstar"])]] * n
                continue
            if c == "p" and n == 1 and token[i : i + 1] == "h" and token[i + 1 : i + 2] != "h":
                out.append([("ph", 0.0), ("f", COST["sound"])])
                i += 1
                continue
            if c.isalpha():
                arcs.append((c, 0.0 if script(c) in (target, "h") else 3.0))
                if c in ALIKE and target == "l":
                    arcs.append((ALIKE[c], COST["alike"]))
                if target == "c" and c in BACK:
                    arcs.append((BACK[c], COST["alike"]))
            for x in LEET.get(c, ""):
                if script(x) == target:
                    arcs.append((x, COST["leet"]))
            if not c.isalpha():
                arcs += [(c, 2.0), ("", COST["drop"]), (" ", COST["apart"])] if not c.isdigit() else [(c, 4.0)]
            if n == 1:
                out.append(arcs)
            else:  # a run: meant once or twice; of two, two is as likely
                one, two = (COST["one"], COST["two"]) if n > 2 else (pair, 0.0)
                out.append([(x, k + one) for x, k in arcs if x] + [(x + x, 2 * k + two) for x, k in arcs if x.strip()] + [("", k) for x, k in arcs if not x])
        return out

    def decode(self, token: str, apart: bool = False) -> str:
        """The cheapest path through the lattice. A state is the last two letters and the place in the tree of known words
        (-1: none begins so), with the path's cost and its last step. apart: words may end anywhere within the token."""
        cost, end, tree = self.model.cost, self.model.end, self.model.tree
        lattice = self.lattice(token)
        if not apart and all(len(arcs) == 1 for arcs in lattice):  # nothing else can be meant
            return token
        start = (" ", " ", 0)
        states: dict[tuple[str, str, int], tuple[float, tuple | None]] = {start: (0.0, None)}
        for n, arcs in enumerate(lattice):
            if apart and n:
                v, step = min(((v + end(*s) + COST["apart"], step) for s, (v, step) in states.items()), key=lambda x: x[0])
                if start not in states or v < states[start][0]:
                    states[start] = (v, (step, " "))
            new: dict[tuple[str, str, int], tuple[float, tuple | None]] = {}
            for (a, b, node), (v, step) in states.items():
                for x, k in arcs:
                    if x == " ":
                        s, w = start, v + k + end(a, b, node)
                    else:
                        p, q, m, w = a, b, node, v + k
                        for y in x:
                            w += cost(p, q, y)
                            p, q, m = q, y, tree[m].get(y, -1) if m >= 0 else -1
                        s = (p, q, m)
                    old = new.get(s)
                    if old is None or w < old[0]:
                        new[s] = (w, (step, x) if x else step)
            states = new
        step = min(((v + end(*s), step) for s, (v, step) in states.items()), key=lambda x: x[0])[1]
        out = []
        while step:
            step, x = step
            out.append(x)
        return "".join(reversed(out))
