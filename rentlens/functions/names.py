"""Person names: tokens, host and owner matches, scored host and licence matches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import without_marks

#: Words that make an owner a company; words that say nothing in a business name.
CORPORATE = ("llc", "inc", "trust", "properties", "rentals", "management", "company", "corp")
IGNORED = (
    "AND THE A AN OF DBA LLC LTD INC CORP CO COMPANY TRUST ESTATE PROPERTIES PROPERTY MANAGEMENT RENTALS RENTAL HOLDINGS INVESTMENTS GROUP SERVICES DR MR MRS MS JR SR II III IV"
).split()
#: Variants of a first name; the first of a line stands for all, and the last line that has one wins.
VARIANTS = """
ALEXANDER ALEX XANDER
ALEXANDRA ALEX LEXI
ANTHONY TONY
BENJAMIN BEN
CHARLES CHARLIE CHUCK
CHRISTOPHER CHRIS
DANIEL DAN DANNY
DAVID DAVE
EDWARD ED EDDIE TED
ELIZABETH LIZ BETH LIZZY
FRANCIS FRANK
FREDERICK FRED FREDDIE
GREGORY GREG
JACOB JAKE
JAMES JIM JIMMY
JENNIFER JEN JENNY
JOHN JOHNNY JACK
JOSEPH JOE JOEY
KATHERINE KATHRYN KATE KATIE KATHY
MARGARET MAGGIE MEG PEGGY
MATTHEW MATT
MICHAEL MIKE
NICHOLAS NICK
PATRICIA PAT PATTY
REBECCA BECKY BECCA
RICHARD RICK RICH DICK
ROBERT ROB BOB BOBBY
SAMUEL SAM
STEPHEN STEVEN STEVE
SUSAN SUSANNE SUZANNE SUE SUSIE SUZY
THOMAS TOM TOMMY
WILLIAM WILL BILL BILLY
"""
#: Least of all, least mean, and least single similarity of fuzzy matches.
FUZZY_ALL, FUZZY_MEAN, FUZZY_ONE = 0.84, 0.9, 0.86


def tokens(name: Column) -> Column:
    """Runs of a-z of the name in lower case, marks dropped."""
    return F.regexp_extract_all(F.lower(without_marks(F.coalesce(name, F.lit("")))), F.lit("[a-z]+"), 0)


def ascii_tokens(name: Column) -> Column:
    """tokens() of names that are known to be ASCII: no Python."""
    return F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z]+"), 0)


def name_match(host: Column, owner: Column, nicknames: Column) -> Column:
    """owner_name, owner_first_name, owner_nickname or null, of token arrays.

    nicknames: map of a token to its nicknames and canonicals. A company's owner never matches. Several host tokens
    that the owner has make the name; one host token is a first name; a nickname needs another shared token, unless
    the host has one token only.
    """
    off = (F.size(host) == 0) | (F.size(owner) == 0) | F.arrays_overlap(owner, F.array(*map(F.lit, CORPORATE)))
    whole = (host == owner) | ((F.size(host) > 1) & (F.size(F.array_except(host, owner)) == 0))
    first = (F.size(host) == 1) & F.array_contains(owner, host[0])
    nick = F.exists(host, lambda h: F.coalesce(F.arrays_overlap(F.try_element_at(nicknames, h), owner), F.lit(False)))
    return F.when(off, None).when(whole, "owner_name").when(first, "owner_first_name").when(nick & ((F.size(host) == 1) | F.arrays_overlap(host, owner)), "owner_nickname")


class Owners:
    """name_match() of many hosts with some owners at once, in a task. Each is a list of names: the owner's, then those of permits."""

    def __init__(self, lists: list[list[list[str | None] | None]], nicknames: dict[str, list[str]]):
        self.nicknames = nicknames
        number: dict[tuple, int] = {}
        known = [[number.setdefault(tuple(n), len(number)) if n else -1 for n in names] for names in lists]
        self.names = number
        self.off = np.array([not set(n).isdisjoint(CORPORATE) for n in number], bool)
        having: dict[str | None, list[int]] = {}
        for k, n in enumerate(number):
            for t in set(n):
                having.setdefault(t, []).append(k)
        self.having = {t: np.array(k) for t, k in having.items()}
        self.owner = np.array([k[0] for k in known], np.int64)
        permits: list[tuple[list[int], list[int]]] = []
        for row, k in enumerate(known):
            for n, x in enumerate(dict.fromkeys(x for x in k[1:] if x >= 0)):
                if n == len(permits):
                    permits.append(([], []))
                permits[n][0].append(row)
                permits[n][1].append(x)
        self.permits = [tuple(map(np.array, p)) for p in permits]

    def kinds(self, hosts: list[list[str | None] | None]) -> np.ndarray:
        """By host and list, and a row more for no host: 0 none, 1 to 3 by the owner's name, 4 to 6 by the first permit that matches."""
        by_name = np.zeros((len(hosts) + 1, len(self.names) + 1), np.int32)  # the last name matches nothing
        for row, host in zip(by_name, hosts, strict=False):
            if host:
                row[:-1] = self._of(host)
        out = by_name[:, self.owner]
        for lists, found in reversed(self.permits):
            m = by_name[:, found]
            out[:, lists] = np.where(m > 0, m + 3, out[:, lists])
        return out

    def _of(self, host: list[str | None]) -> np.ndarray:
        shared, nick = np.zeros(len(self.names), np.int32), np.zeros(len(self.names), bool)
        own = {t for t in host if t is not None}
        for t in own & self.having.keys():
            shared[self.having[t]] += 1
        for t in {n for h in own for n in self.nicknames.get(h, ())} & self.having.keys():
            nick[self.having[t]] = True
        one, some = len(host) == 1, shared > 0
        whole = (shared == len(own)) & (not one)
        if None in host and not one:
            null = np.zeros(len(self.names), bool)
            null[self.having.get(None, [])] = True
            whole &= null
        if (same := self.names.get(tuple(host))) is not None:
            whole[same] = True
        out = np.select([whole, some & one, nick & (some | one)], [1, 2, 3], 0)
        out[self.off] = 0
        return out


def normal_name(name: Column, ascii_only: bool = False) -> Column:
    """Upper-case letters and digits in single spaces, & as AND."""
    c = F.coalesce(name, F.lit(""))
    c = c if ascii_only else without_marks(c)
    return F.trim(F.regexp_replace(F.replace(F.upper(c), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " "))


def meaningful(normal: Column) -> Column:
    """Tokens of three characters or more that say something."""
    return F.filter(F.split(normal, " "), lambda t: (F.char_length(t) >= 3) & ~t.isin(*IGNORED))


def canonical_map() -> Column:
    made: dict[str, str] = {}
    for line in VARIANTS.split("\n"):
        for token in line.split():
            made[token] = line.split()[0]
    return F.create_map(*(F.lit(x) for pair in made.items() for x in pair))


def canonical(token_array: Column) -> Column:
    m = canonical_map()
    return F.transform(token_array, lambda t: F.coalesce(F.try_element_at(m, t), t))


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))


def classify(host: Column, business: Column, host_tokens: Column, business_tokens: Column) -> Column:
    """struct(match_type, confidence, score) of normal names and their meaningful tokens: the first rule that holds.

    Null where neither rule holds or either has no token. The order of the rules decides, not the score.
    """
    n = F.size(host_tokens)
    one, several = n == 1, n >= 2
    made = lambda kind, sure, score: F.struct(F.lit(kind).alias("match_type"), F.lit(sure).alias("confidence"), (score if isinstance(score, Column) else F.lit(float(score))).alias("score"))
    has_all = F.size(F.array_except(host_tokens, business_tokens)) == 0
    prefix = lambda h: F.exists(business_tokens, lambda b: (F.char_length(h) >= 4) & (F.char_length(b) >= 4) & (F.startswith(h, b) | F.startswith(b, h)))
    variants = F.size(F.array_except(canonical(host_tokens), canonical(business_tokens))) == 0
    shared = F.exists(host_tokens, lambda h: (F.char_length(h) >= 4) & F.array_contains(business_tokens, h))
    scores = F.transform(host_tokens, lambda h: F.array_max(F.transform(business_tokens, lambda b: similarity(h, b))))
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / n
    out = F.when((host == "") | (business == "") | (n == 0) | (F.size(business_tokens) == 0), None)
    for rule, kind in (
        (host == business, made("exact_full_name", "high", 1)),
        ((F.char_length(host) >= 5) & F.contains(F.concat(F.lit(" "), business, F.lit(" ")), F.concat(F.lit(" "), host, F.lit(" "))), made("complete_name_in_license", "high", 0.97)),
        (several & has_all, made("all_host_name_tokens", "high", 0.94)),
        (one & (F.char_length(host_tokens[0]) >= 4) & has_all, made("one_name_match", "medium", 0.78)),
        (one & F.exists(host_tokens, prefix), made("one_name_prefix_match", "medium", 0.74)),
        (several & F.forall(host_tokens, prefix), made("all_name_prefix_matches", "medium", 0.86)),
        (one & variants, made("one_name_variant_match", "medium", 0.75)),
        (several & variants, made("all_name_variants_match", "high", 0.9)),
        (shared, made("partial_name_match", "low", 0.66)),
        (several & (F.array_min(scores) >= FUZZY_ALL) & (mean >= FUZZY_MEAN), made("fuzzy_name_match", "medium", F.round(mean, 4))),
        (one & (F.char_length(host_tokens[0]) >= 5) & (scores[0] >= FUZZY_ONE), made("fuzzy_one_name_match", "low", F.round(scores[0], 4))),
    ):
        out = out.when(rule, kind)
    return out


def _edits(length: Column) -> Column:
    """Edits that leave two tokens, the longer of this length, as similar as a fuzzy match asks."""
    return F.floor(length * (1 - FUZZY_ALL) + 1e-9).cast("int")


def fuzzy_keys(token: Column, longer: bool) -> Column:
    """Keys of a token, such that two that fuzzy matches may take for one share a key: one's as the longer, the other's not.

    Among k edits one of k + 1 even pieces of the shorter token stays whole, and lies in the longer one within k places
    of where it was. Keys hold both lengths, the piece's number, and its letters.
    """
    length = F.char_length(token)
    key = lambda m, n, i, text: F.concat_ws(":", m, n, i, text)
    begin = lambda n, i, k: F.floor(i * n / (k + 1)).cast("int")
    numbers = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    def of_longer(n: Column) -> Column:  # n: the shorter's length
        k = _edits(length)

        def piece(i: Column) -> Column:
            at, size = begin(n, i, k), begin(n, i + 1, k) - begin(n, i, k)
            return F.transform(numbers(F.greatest(at - k, F.lit(0)), F.least(at + k, length - size)), lambda p: key(length, n, i, token.substr(p + 1, size)))

        return F.flatten(F.transform(numbers(F.lit(0), k), piece))

    def of_shorter(m: Column) -> Column:  # m: the longer's length
        k = _edits(m)
        return F.transform(numbers(F.lit(0), k), lambda i: key(m, length, i, token.substr(begin(length, i, k) + 1, begin(length, i + 1, k) - begin(length, i, k))))

    if longer:
        return F.flatten(F.transform(numbers(F.greatest(length - _edits(length), F.lit(1)), length), of_longer))
    widest = F.ceil(length / FUZZY_ALL).cast("int")
    return F.flatten(F.transform(F.filter(numbers(length, widest), lambda m: m - length <= _edits(m)), of_shorter))


def pair_keys(token_array: Column, host: bool) -> Column:
    """Keys of a name by its meaningful tokens: a host and a business that classify() matches share one.

    Rules want a token in common, whole, by its first four letters or as a variant, or tokens that are nearly equal.
    """
    tagged = lambda tag, keys: F.transform(keys, lambda x: F.concat(F.lit(tag), x))
    begins = F.transform(F.filter(token_array, lambda t: F.char_length(t) >= 4), lambda t: F.substring(t, 1, 4))
    near = [F.flatten(F.transform(token_array, lambda t: fuzzy_keys(t, longer))) for longer in (host, not host)]  # noqa: B023
    return F.array_distinct(F.concat(tagged("t", token_array), tagged("b", begins), tagged("v", canonical(token_array)), tagged("x", near[0]), tagged("y", near[1])))
