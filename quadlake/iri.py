"""IRIs and language tags: validation, resolution against a base, and the way back."""

from __future__ import annotations

import re

_SPLIT = re.compile(r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
_UCS = " -퟿豈-﷏ﷰ-￯\U00010000-\U000efffd"
_PCT = r"%[0-9A-Fa-f]{2}"
_PCHAR = rf"(?:[A-Za-z0-9\-._~!$&'()*+,;=:@{_UCS}]|{_PCT})"
_SEG_NC = rf"(?:[A-Za-z0-9\-._~!$&'()*+,;=@{_UCS}]|{_PCT})+"
_HOST = rf"(?:\[(?:[0-9A-Fa-f:.]+|v[0-9A-Fa-f]+\.[A-Za-z0-9\-._~!$&'()*+,;=:]+)\]|(?:[A-Za-z0-9\-._~!$&'()*+,;={_UCS}]|{_PCT})*)"
_AUTH = rf"(?:(?:[A-Za-z0-9\-._~!$&'()*+,;=:{_UCS}]|{_PCT})*@)?{_HOST}(?::[0-9]*)?"
_TAIL = rf"(?:\?(?:{_PCHAR}|[/?-])*)?(?:#(?:{_PCHAR}|[/?])*)?"
#: For Spark's rlike as well.
ABSOLUTE_IRI = rf"^[A-Za-z][A-Za-z0-9+\-.]*:(?://{_AUTH}(?:/{_PCHAR}*)*|/(?:{_PCHAR}+(?:/{_PCHAR}*)*)?|{_PCHAR}+(?:/{_PCHAR}*)*|){_TAIL}$"
RELATIVE_IRI = rf"^(?://{_AUTH}(?:/{_PCHAR}*)*|/(?:{_PCHAR}+(?:/{_PCHAR}*)*)?|{_SEG_NC}(?:/{_PCHAR}*)*|){_TAIL}$"
_ABS, _REL = re.compile(ABSOLUTE_IRI), re.compile(RELATIVE_IRI)
#: Without look-around, for Spark's rlike as well.
LANG_TAG = r"(?i)^((([a-z]{2,3}(-[a-z]{3}){0,3})|[a-z]{4}|[a-z]{5,8})(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?(-([a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(-[a-wy-z0-9](-[a-z0-9]{2,8})+)*(-x(-[a-z0-9]{1,8})+)?|x(-[a-z0-9]{1,8})+|i-[a-z]+|en-gb-oed|sgn-be-fr|sgn-be-nl|sgn-ch-de|art-lojban|cel-gaulish|no-bok|no-nyn|zh-guoyu|zh-hakka|zh-min|zh-min-nan|zh-xiang)$"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+\-.]*:[^\x00-\x20<>\"{}|\\^`]*$"


def is_absolute(iri: str) -> bool:
    return bool(_ABS.match(iri))


def is_relative(iri: str) -> bool:
    return bool(_REL.match(iri))


def is_valid(iri: str) -> bool:
    return is_absolute(iri) or is_relative(iri)


def is_uri(iri: str) -> bool:
    return iri.isascii() and is_absolute(iri)


def is_language_tag(tag: str) -> bool:
    return bool(re.match(LANG_TAG, tag))


def split(iri: str) -> tuple:
    return _SPLIT.match(iri).groups()


def join(scheme, authority, path, query, fragment) -> str:
    return (f"{scheme}:" if scheme is not None else "") + (f"//{authority}" if authority is not None else "") + path + (f"?{query}" if query is not None else "") + (f"#{fragment}" if fragment is not None else "")


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, x in enumerate(parts):
        last = i == len(parts) - 1
        if x == "." or x == "..":
            if x == ".." and len(out) > 1:
                out.pop()
            if last:
                out.append("")
        else:
            out.append(x)
    return "/".join(out)


def resolve(base: str, reference: str) -> str:
    """RFC 3986, section 5.2."""
    b, r = split(base), split(reference)
    if r[0] is not None:
        return join(r[0], r[1], _without_dots(r[2]), r[3], r[4])
    if r[1] is not None:
        return join(b[0], r[1], _without_dots(r[2]), r[3], r[4])
    if not r[2]:
        return join(b[0], b[1], b[2], r[3] if r[3] is not None else b[3], r[4])
    if r[2].startswith("/"):
        path = r[2]
    elif b[1] is not None and not b[2]:
        path = "/" + r[2]
    else:
        path = b[2][: b[2].rfind("/") + 1] + r[2]
    return join(b[0], b[1], _without_dots(path), r[3], r[4])


def relativize(base: str, iri: str, parents: int = 0) -> str:
    """The shortest of the usual references that resolves to iri, climbing `parents` folders at most; iri itself if there is none."""
    b, i = split(base), split(iri)
    options = []
    if b[:2] == i[:2]:
        tail = join(None, None, "", i[3], i[4])
        if b[2] == i[2]:
            options += [join(None, None, "", None, i[4])] if i[3] == b[3] else []
            options.append(tail)
        folders, own = b[2].split("/")[:-1], i[2].split("/")
        common = 0
        while common < len(folders) and common < len(own) - 1 and folders[common] == own[common]:
            common += 1
        up = len(folders) - common
        if common and up <= parents:
            path = "../" * up + "/".join(own[common:])
            options.append((path or "./") + tail)
            options.append("./" + path + tail)
        options.append(i[2] + tail)
    options.append(join(None, *i[1:]) if i[1] is not None and b[0] == i[0] else iri)
    good = [x for x in options if is_valid(x) and resolve(base, x) == iri]
    return min(good, key=len) if good else iri
