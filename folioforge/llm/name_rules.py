"""When two spellings can name the same person or body: plain-Python rules."""

from __future__ import annotations

# Everyday short forms of given names (Polish, English, German).
SHORT_FORMS = {
    "adelka": "adelaida", "addie": "adelaide", "agatka": "agata", "ala": "alicja", "alex": "alexander", "alek": "aleksander",
    "olek": "aleksander", "ola": "aleksandra", "sandy": "alexander", "jedrek": "andrzej", "ania": "anna", "anka": "anna",
    "hania": "hanna", "tosia": "antonina", "antek": "antoni", "polcia": "apolonia", "pola": "apolonia", "gus": "augustin", "gucio": "augustin",
    "basia": "barbara", "baska": "barbara", "babs": "barbara", "bart": "bartholomew", "beatka": "beata", "bea": "beatrice", "trixie": "beatrice",
    "ben": "benjamin", "benek": "benjamin", "bogus": "bogdan", "bodzio": "bogdan", "bolek": "boleslaw", "bronek": "bronislaw", "bronka": "bronislawa", "bronia": "bronislawa",
    "celinka": "celina", "cela": "celina", "czarek": "cezary", "lottie": "charlotte", "kit": "christopher", "chris": "christopher",
    "clem": "clementine", "connie": "constance", "delia": "cordelia", "danka": "danuta", "danusia": "danuta", "darek": "dariusz",
    "dieter": "dietrich", "dolly": "dorothea", "dot": "dorothea", "dora": "dorothea", "dorka": "dorota", "dorotka": "dorota", "edek": "edward", "ed": "edward", "ned": "edward", "ted": "theodore", "teddy": "theodore",
    "ela": "elzbieta", "elka": "elzbieta", "lizzie": "elisabeth", "betty": "elisabeth", "liesl": "elisabeth", "lisa": "elisabeth", "ewka": "ewa", "emilka": "emilia", "milka": "emilia", "emi": "emilia", "erna": "ernestine",
    "eva": "evangeline", "evie": "evangeline", "fela": "felicja", "felek": "feliks", "ferdek": "ferdinand", "ferdy": "ferdinand", "filek": "filip", "flo": "florence", "florrie": "florence",
    "franka": "franciszka", "frania": "franciszka", "fred": "frederick", "freddie": "frederick", "fritz": "friedrich", "genia": "genowefa", "gienia": "genowefa", "gerd": "gerhard", "friedl": "gottfried",
    "grazka": "grazyna", "grzes": "grzegorz", "grzesiek": "grzegorz", "gucia": "augusta", "gwen": "gwendolyn", "halinka": "halina", "hala": "halina", "heini": "heinrich", "heinz": "heinrich",
    "hela": "helena", "helenka": "helena", "etta": "henrietta", "hattie": "henrietta", "hetty": "henrietta", "heniek": "henryk", "henio": "henryk", "hirek": "hieronim", "hubi": "hubert", "ignas": "ignacy", "irka": "irena", "bella": "isabella",
    "iwonka": "iwona", "jadzia": "jadwiga", "janek": "jan", "jas": "jan", "jarek": "jaroslaw", "jurek": "jerzy", "asia": "joanna", "joasia": "joanna", "jola": "jolanta", "jon": "jonathan", "jonty": "jonathan",
    "josie": "josephine", "jo": "josephine", "julka": "julia", "justynka": "justyna", "karolek": "karol", "kacper": "kasper", "kasia": "katarzyna", "kaska": "katarzyna", "kazik": "kazimierz", "kazio": "kazimierz",
    "kordzik": "konrad", "konradek": "konrad", "krysia": "krystyna", "kryska": "krystyna", "krzysiek": "krzysztof", "krzys": "krzysztof", "leszek": "lech", "leo": "leopold", "poldek": "leopold", "lusia": "lucja", "lucia": "lucja", "ludka": "ludwika",
    "magda": "magdalena", "madzia": "magdalena", "maks": "maksymilian", "gosia": "malgorzata", "malgosia": "malgorzata", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "marysia": "maria", "maryla": "maria", "mania": "marianna",
    "mareczek": "marek", "misiek": "michal", "michas": "michal", "mietek": "mieczyslaw", "millie": "millicent", "mirek": "miroslaw", "natalka": "natalia", "nat": "nathaniel", "nate": "nathaniel", "norbi": "norbert",
}
SHORT_FORMS |= {
    "olenka": "aleksandra", "olcia": "olga", "oskarek": "oskar", "tilly": "ottilie", "ottla": "ottilie", "paula": "paulina", "paulinka": "paulina", "pawelek": "pawel", "penny": "penelope", "pippa": "philippa", "mena": "philomena",
    "piotrek": "piotr", "przemek": "przemyslaw", "radek": "radoslaw", "rafalek": "rafal", "gina": "regina", "renia": "renata", "ren": "renata", "romek": "roman", "roz": "rosalind", "rosie": "rosalind",
    "rozia": "rozalia", "rudi": "rudolf", "rysiek": "ryszard", "rys": "ryszard", "sam": "samuel", "seba": "sebastian", "sewek": "seweryn", "siggi": "sigmund", "sigi": "sigmund", "staszek": "stanislaw", "stasiek": "stanislaw", "stefek": "stefan",
    "sue": "susannah", "susie": "susannah", "sukey": "susannah", "sylwka": "sylwia", "szymek": "szymon", "tadek": "tadeusz", "tadzio": "tadeusz", "tereska": "teresa", "thad": "thaddeus", "theo": "theodore", "tomek": "tomasz",
    "ula": "urszula", "urszulka": "urszula", "uschi": "ursula", "val": "valentine", "ronnie": "veronica", "vera": "veronica", "vince": "vincent", "wala": "walentyna", "wally": "walter", "walt": "walter", "wandzia": "wanda", "weronka": "weronika", "nika": "weronika",
    "wiktorek": "wiktor", "wilma": "wilhelmina", "minna": "wilhelmina", "mina": "wilhelmina", "wladek": "wladyslaw", "wojtek": "wojciech", "zach": "zachary", "zack": "zachary", "zbyszek": "zbigniew", "zosia": "zofia", "zoska": "zofia", "zuzia": "zuzanna",
    "zuza": "zuzanna", "zygmus": "zygmunt", "zyga": "zygmunt",
}
GIVEN_NAMES = frozenset(SHORT_FORMS) | frozenset(SHORT_FORMS.values())
# Short forms of words in the names of bodies.
SHORT_FORMS |= {"br": "bractwo", "tow": "towarzystwo", "prac": "pracownia", "sp": "spolka", "kol": "kolektyw", "red": "redakcja", "zb": "zbiorowa", "aut": "autorska", "zesp": "zespol", "natka": "natalia", "zuzka": "zuzanna"}
# Short forms of two names; each is tried.
SECOND_FORMS = {"teddy": "edward", "ted": "edward", "sandy": "alexandra", "fritz": "frederick", "alex": "alexandra", "leo": "leon", "ola": "olga", "dora": "dorota", "mina": "philomena", "ren": "reinhard", "lech": "leszek", "eva": "ewa", "lusia": "ludwika", "liz": "elisabeth"}


def full_forms(token: str) -> set[str]:
    """The token and the names it is a short form of."""
    return {token, SHORT_FORMS.get(token, token), SECOND_FORMS.get(token, token)}


def edits(x: str, y: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting as one; ``most`` + 1 when beyond ``most``."""
    if x == y:
        return 0
    if abs(len(x) - len(y)) > most:
        return most + 1
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    end = 0
    while end < min(len(x), len(y)) - start and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = x[start : len(x) - end], y[start : len(y) - end]
    if max(len(x), len(y)) <= 1:
        return 1
    if len(x) == len(y) == 2 and x == y[::-1]:
        return 1
    if most <= 1:
        return 2
    if not x or not y:
        return len(x) + len(y)
    # a letter that the other word has not costs an edit each
    own, other = set(x), set(y)
    if len(own - other) > most or len(other - own) > most:
        return most + 1
    # the columns of the table of edits as bits of one number (Hyyrö 2003, with swaps)
    at: dict[str, int] = {}
    for i, a in enumerate(x):
        at[a] = at.get(a, 0) | 1 << i
    full, top, d = (1 << len(x)) - 1, 1 << len(x) - 1, len(x)
    up, down, zero, before = full, 0, 0, 0
    for left, b in zip(range(len(y) - 1, -1, -1), y):
        here = at.get(b, 0)
        swap = (~zero & here) << 1 & before
        zero = ((here & up) + up ^ up | here | down | swap) & full
        right, back = down | full & ~(zero | up), zero & up
        d += (right & top > 0) - (back & top > 0)
        if d - left > most:
            return most + 1
        right, back = (right << 1 | 1) & full, back << 1 & full
        up, down, before = back | full & ~(zero | right), right & zero, here
    return min(d, most + 1)


def given_likeness(x: str, y: str, common: frozenset, most: int) -> float:
    """Likeness of two given names (or words of a body's name), 0 if they cannot be one."""
    if x == y:
        return 1.0
    if len(x) == 1 or len(y) == 1:
        letter, name = (x, y) if len(x) == 1 else (y, x)
        return 0.75 if any(f[0] == letter for f in full_forms(name)) else 0.0
    if full_forms(x) & full_forms(y):
        return 0.9
    if x in common and y in common:
        return 0.0
    short, long = (x, y) if len(x) < len(y) else (y, x)
    if long.startswith(short):
        return 0.85
    if len(short) >= 3:
        d = edits(x, y, most)
        if d <= most and d < len(short) - 1:
            return 0.9 if d == 1 else 0.7
        for full in (full_forms(short) | full_forms(long)) - {short, long}:
            if edits(full, long if full != long else short, 1) <= 1:
                return 0.7
    return 0.0


def deletions(word: str) -> set[str]:
    """The word and, from 5 letters, what is left without one of them: words of one edit share one of these."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 4 else set())


def given_keys(x: str) -> set[tuple[str, bool]]:
    """(key, whole): two given names that can be one (one edit allowed) share a key which is whole for one of them at least."""
    keys = {("<" + x[:i], i == len(x)) for i in range(1, len(x) + 1)}
    for full in full_forms(x):
        keys |= {("~" + full, True), ("<" + full[0], len(x) == 1)}
        if len(full) > 2:
            keys |= {("~" + full[:i] + full[i + 1 :], True) for i in range(len(full))}
    return keys


def family_likeness(x: str, y: str, common: frozenset, most: int) -> float:
    """Likeness of two rare name words; common words are never family names."""
    if x in common or y in common or min(len(x), len(y)) < 3:
        return 0.0
    if x == y:
        return 1.0
    if min(len(x), len(y)) < 5:
        return 0.0
    d = edits(x, y, most)
    return 0.0 if d > most else 0.9 if d == 1 else 0.7


def _givens(a: list[str], b: list[str], common: frozenset, most: int) -> float:
    """The first must agree, of the rest the shorter list must be found in the longer in order."""
    if not a or not b:
        return 0.0
    got = [given_likeness(a[0], b[0], common, most)]
    if not got[0]:
        return 0.0
    short, long = (a[1:], b[1:]) if len(a) <= len(b) else (b[1:], a[1:])
    at = 0
    for x in short:
        while at < len(long) and not given_likeness(x, long[at], common, most):
            at += 1
        if at == len(long):
            return 0.0
        got.append(given_likeness(x, long[at], common, most))
        at += 1
    return sum(got) / len(got) - 0.05 * (len(long) - len(short))


def likeness(a: list[str], b: list[str], common: frozenset, most: int = 1) -> float:
    """Likeness of two names as word lists, the family name first or last in each."""
    best = 0.0
    for fa, ga in ((a[-1], a[:-1]), (a[0], a[1:])) if len(a) > 1 else ():
        for fb, gb in ((b[-1], b[:-1]), (b[0], b[1:])) if len(b) > 1 else ():
            fam = family_likeness(fa, fb, common, most)
            if fam:
                best = max(best, fam * _givens(ga, gb, common, most))
    return best
