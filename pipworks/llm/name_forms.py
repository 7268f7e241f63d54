"""Names as typed, taken apart: people, handles, and events.

A form is a short string that spellings of one entity share unless they differ by typing errors, abbreviations or missing
parts: `p|given names|initial|surname`, `h|letters|number`, `e|year|kinds|place`.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import xxhash

from pipworks.llm.sequences import edit_distance_at_most

# Given names and their short forms.
GIVEN_NAMES = {
    "alexander": "alex alec al sandy sasha xander lex", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny benji", "catherine": "cathy kate katie kathy cat kitty cath", "charles": "charlie chuck chas",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "dorothea": "dot dora dottie thea dolly dory dorothy", "edmund": "ed eddie ned ted eddy", "edward": "ed eddie ned ted eddy teddy", "elizabeth": "liz lizzie beth betty eliza bess",
    "frederick": "fred freddy freddie fritz", "gabriel": "gabe gab", "george": "georgie", "henrietta": "hetty henny etta hattie hen", "henry": "harry hank hal", "isabella": "izzy bella isa belle ibby isabel bel", "jacob": "jake", "james": "jim jimmy jamie",
    "john": "johnny jack", "joseph": "joe joey", "josephine": "josie jo posy josy", "leonard": "leo len lenny", "margarethe": "peggy maggie greta meg marge margie grete madge margaret", "matthew": "matt matty", "michael": "mike mick mickey", "nathaniel": "nat nate",
    "nicholas": "nick nicky", "oliver": "ollie noll olly", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becky becca", "richard": "rick ricky dick rich richie dickie", "robert": "bob bobby rob robbie", "samuel": "sam sammy", "stephen": "steve stevie",
    "susanna": "sue suzy", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vic vicky tori vicki vickie", "walter": "walt wally", "william": "will bill billy willy wills",
}
#: Marks after a name.
NAME_MARKS = ["jr", "sr", "junior", "senior", "ii", "iii", "gm", "im"]
#: Words for kinds of events, the more usual first, and kinds of two words.
EVENT_KINDS = (
    "open masters cup grand prix winter trophy festival club championship team league weekly monthly summer spring autumn classic challenge invitational memorial series marathon derby national city"
).split()
EVENT_PAIRS = [("grand", "prix"), ("winter", "trophy"), ("club", "championship"), ("team", "league"), ("weekly", "league")]
#: Words that say nothing about which event it is.
EVENT_FILLERS = ["backgammon", "bg", "the", "of", "de", "at", "in", "intl", "international", "int", "annual", "trn", "tournament", "tourn", "tournoi", "turnier", "torneo", "edition"]
#: Texts that stand where an event is not known.
EVENT_PLACEHOLDERS = ["", "onlinematch", "online", "match", "unknown", "na", "none", "null", "tba", "event", "friendly", "casual", "nn", "unnamed"]
# Letters that have no decomposition.
_FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})

_CLASSES: dict[str, tuple[str, ...]] = {}
for _full, _short in GIVEN_NAMES.items():
    for _name in (_full, *_short.split()):
        _CLASSES[_name] = (*_CLASSES.get(_name, ()), _full)


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFD", text.lower().translate(_FOLD))
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_FOLD)


@lru_cache(maxsize=100_000)
def given_classes(token: str, dotted: bool = False) -> tuple[str, ...]:
    """The given names that a token may stand for: itself, a short form, an abbreviation, or one typing error away."""
    if token in _CLASSES:
        return _CLASSES[token]
    if dotted and len(token) >= 2:
        if begun := tuple(sorted(n for n in GIVEN_NAMES if n.startswith(token))):
            return begun
    if len(token) >= 4:
        near = {c for name, cs in _CLASSES.items() if len(name) >= 5 and edit_distance_at_most(token, name, 1) for c in cs}
        return tuple(sorted(near))
    return ()


def player_form(name: str) -> str | None:
    text = unicodedata.normalize("NFC", name).strip()
    text = re.sub(r"\s*[\(\[][^)\]]*[\)\]]\s*$", "", text)
    text = re.sub(r"\s*[,;:/]\s*\d{3,4}$", "", text)
    text = re.sub(rf"[\s,]+(?:{'|'.join(NAME_MARKS)})\.?$", "", text, flags=re.IGNORECASE)
    text = re.sub(r"[\s*+†!?]+$", "", text)
    if m := re.fullmatch(r"(.*?[^\d])(\d+)", text):
        letters = "".join(c for c in fold(m[1]) if c.isalnum())
        return f"h|{letters}|{m[2]}" if letters else None
    comma = "," in text
    if not re.search(r"[\s_.,-]", text):  # written together, with capitals inside
        text = "".join(f" {c}" if c.isupper() and before.islower() else c for before, c in zip(f" {text}", text, strict=False))
    parts = [(fold(w), dot == ".") for w, dot in re.findall(r"([^\W\d_]+(?:['’][^\W\d_]+)?)(\.?)", text)]
    full = [(w, dot) for w, dot in parts if len(w) > 1]
    initials = [w for w, _ in parts if len(w) == 1]
    if not full:
        return None
    known = [k for k, (w, dot) in enumerate(full) if given_classes(w, dot)]
    exact = [k for k in known if full[k][0] in _CLASSES]
    if len(full) == 1 and (initials or not known):
        given, classes = None, ()
    elif known:
        choice = exact or known
        given = choice[-1] if comma else choice[0]
        classes = given_classes(*full[given])
    else:
        given = (len(full) - 1 if comma else 0) if not initials else None
        classes = ("x:" + full[given][0],) if given is not None else ()
    surname = "".join(w for k, (w, _) in enumerate(full) if k != given)
    if not surname:  # one name only
        return f"p||{full[0][0]}|"
    return f"p|{'/'.join(classes)}|{initials[0] if initials and not classes else ''}|{surname}"


def event_form(event: str) -> str | None:
    text = fold(event)
    if "".join(c for c in text if c.isalpha()) in EVENT_PLACEHOLDERS:
        return None
    year = re.search(r"(?<!\d)(?:19|20)\d\d(?!\d)", text)
    short = re.search(r"['’`](\d\d)(?!\d)", text)
    when = year[0] if year else ("19" if int(short[1]) >= 40 else "20") + short[1] if short else ""
    text = re.sub(r"\d+(?:st|nd|rd|th)?\b", " ", text)
    kinds, place, cut = set(), [], False
    words = [(w, dot == ".") for w, dot in re.findall(r"([^\W\d_]+)(\.?)", text) if w not in EVENT_FILLERS]
    for k, (word, dot) in enumerate(words):
        if found := _kinds(word, dot, words[k + 1] if k + 1 < len(words) else None):
            kinds |= set(found)
        else:
            place.append(word)
            cut |= dot
    if not place and not kinds:
        return None
    return f"e|{when}|{' '.join(sorted(kinds))}|{''.join(place)}{'.' if cut else ''}"


def _kinds(word: str, dotted: bool, following: tuple[str, bool] | None) -> tuple[str, ...]:
    """The kinds that a word stands for: one, both of a pair run together or given by its initials, or the first of a pair by its initial."""
    for pair in EVENT_PAIRS:
        if word == "".join(pair) or not dotted and word == pair[0][0] + pair[1][0]:
            return pair
        if dotted and len(word) == 1 and word == pair[0][0] and following and _kind(*following) == pair[1]:
            return pair[:1]
    kind = _kind(word, dotted)
    return (kind,) if kind else ()


def _abbreviates(word: str, kind: str) -> bool:
    """Whether a word has the first letter and further letters of a kind in order; of two letters, none may be a vowel."""
    letters = iter(kind[1:])
    enough = len(word) >= 3 and 3 * len(word) >= len(kind) or len(word) == 2 and not set(word) & set("aeiouy")
    return enough and len(word) < len(kind) and word[0] == kind[0] and all(c in letters for c in word[1:])


@lru_cache(maxsize=100_000)
def _kind(word: str, dotted: bool) -> str | None:
    """The kind that a word is, is cut from, is a typing error of, or abbreviates; the more usual one where several are possible."""
    if word in EVENT_KINDS:
        return word
    tests = [
        lambda k: dotted and len(word) >= 2 and k.startswith(word),
        lambda k: min(len(word), len(k)) >= 3 and edit_distance_at_most(word, k, 2 if min(len(word), len(k)) >= 9 else 1),
        lambda k: _abbreviates(word, k) or word.endswith("s") and _abbreviates(word[:-1], k),
    ]
    return next((k for test in tests for k in EVENT_KINDS if test(k)), None)


def _shorter(word: str) -> list[str]:
    """The word and what is left when any one letter is dropped."""
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}] if len(word) >= 4 else [word]


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _starts(given: str, initial: str) -> set[str]:
    """First letters of the possible given names."""
    return {(c[2:] if c.startswith("x:") else c)[0] for c in given.split("/") if c} or {initial}


def block_keys(form: str) -> list[int]:
    """Keys under which forms meet that may be one entity."""
    kind, *rest = form.split("|")
    if kind == "h":
        letters, number = rest
        texts = [f"h{number} {w}" for w in _shorter("".join(sorted(letters)))]
    elif kind == "e":
        year, kinds, place = rest
        bare = place.rstrip(".")
        texts = [f"e{year} {kinds} {w}" for w in _shorter(bare)] + [f"e{year} {kinds} ~{bare[:3]}"]
        if len(bare) >= 10:
            texts += [f"e{year} {kinds} <{bare[: len(bare) // 2][:5]}", f"e{year} {kinds} >{bare[-5:]}"]
    else:
        given, initial, surname = rest
        texts = [f"p{i} {w}" for i in _starts(given, initial) for w in _shorter(surname)]
    return [_key(t) for t in texts]


def vagueness(form: str) -> int:
    """0 for a form that names its entity in full, 1 where several given names are possible, 2 for an initial alone or an abbreviated place."""
    kind, *rest = form.split("|")
    if kind == "p":
        return 2 if not rest[0] else int("/" in rest[0])
    return 2 * (kind == "e" and rest[2].endswith("."))


def _same_place(a: str, b: str) -> bool:
    x, y = a.rstrip("."), b.rstrip(".")
    if a != x or b != y:
        short, long = (x, y) if a != x and (b == y or len(x) <= len(y)) else (y, x)
        if len(short) >= 2 and long.startswith(short):
            return True
    return edit_distance_at_most(x, y, 2 if min(len(x), len(y)) >= 9 else 1 if min(len(x), len(y)) >= 4 else 0)


def _same_handle(a: str, b: str) -> bool:
    if edit_distance_at_most(a, b, 1):
        return True
    return any(edit_distance_at_most(a[k:] + a[:k], b, 1) for k in range(3, len(a) - 2))


def same_entity(a: str, b: str) -> bool:
    """Whether two forms can be of one entity."""
    x, y = a.split("|"), b.split("|")
    if x[0] != y[0]:
        return False
    if x[0] == "h":
        return x[2] == y[2] and _same_handle(x[1], y[1])
    if x[0] == "e":
        return x[1:3] == y[1:3] and _same_place(x[3], y[3])
    if not same_surname(x[3], y[3]):
        return False
    return same_given((x[1], x[2]), (y[1], y[2]))


def same_given(x: tuple[str, str], y: tuple[str, str]) -> bool:
    """Whether given names (possible names, initial) can be of one person."""
    gx, gy = set(filter(None, x[0].split("/"))), set(filter(None, y[0].split("/")))
    if gx and gy:
        if gx & gy:
            return True
        p, q = min(gx), min(gy)
        return p.startswith("x:") and q.startswith("x:") and min(len(p), len(q)) >= 6 and edit_distance_at_most(p, q, 1)
    if not gx and not gy:
        return bool(x[1]) and x[1] == y[1]
    initial, known = (x[1], gy) if not gx else (y[1], gx)
    return bool(initial) and any((c[2:] if c.startswith("x:") else c).startswith(initial) for c in known)


def same_surname(x: str, y: str) -> bool:
    return edit_distance_at_most(x, y, 1 if min(len(x), len(y)) >= 4 else 0)


def _people(forms: list[str], least: int) -> list[tuple[set, set]]:
    """(given names with initials, surnames) of the people forms of a profile.

    With full given names (`least` 0) every one goes with every surname, also those of members known only in part; else the forms of vagueness `least` stand alone.
    """
    parts = [f.split("|") for f in forms if f.startswith("p|")]
    if parts and least == 0:
        return [({(p[1], "") for p in parts if p[1] and "/" not in p[1]}, {p[3] for p in parts})]
    return [({(p[1], p[2])}, {p[3]}) for p in parts if vagueness("|".join(p)) == least]


def same_profile(a: list[str], vague_a: int, b: list[str], vague_b: int) -> bool:
    """Whether some form of one profile and some form of the other can be of one entity, of the forms that are known best."""
    for given_a, surnames_a in _people(a, vague_a):
        for given_b, surnames_b in _people(b, vague_b):
            met = surnames_a & surnames_b or any(same_surname(x, y) for x in surnames_a for y in surnames_b)
            if met and any(same_given(x, y) for x in given_a for y in given_b):
                return True
    others = [[f for f in forms if not f.startswith("p|") and vagueness(f) == least] for forms, least in ((a, vague_a), (b, vague_b))]
    return any(same_entity(x, y) for x in others[0] for y in others[1])


def profile_keys(forms: list[str]) -> list[int]:
    """Keys of all forms of a profile, and of every given name with every surname."""
    keys = {k for f in forms for k in block_keys(f)}
    for given, surnames in _people(forms, 0):
        starts = {block for name, initial in given for block in _starts(name, initial)}
        keys |= {_key(f"p{i} {w}") for s in surnames for w in _shorter(s) for i in starts}
    return sorted(keys)
