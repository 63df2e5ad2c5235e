"""The part of CSS that decides whether text is seen: ``display`` and ``visibility`` of style sheets.

Read are rules for the screen: those at the top level, in @supports and @layer, and in @media for
all or screen without further conditions. A rule under other conditions (width, print ...) is
not applied. Selectors are compounds of tag, id, classes and plain attributes, joined by
descendant or child combinators; a rule with any other selector part is left out, which shows
text rather than losing it. The cascade goes by importance, specificity and order.
"""

from __future__ import annotations

import re

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile(r"[{};]")
_DECLARATION = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
_PART = re.compile(r"\*|([.#]?)(-?[A-Za-z_][\w-]*)|\[\s*([\w-]+)\s*(?:=\s*[\"\']?([^\"\'\]]*)[\"\']?\s*)?\]")
_COMBINATOR = re.compile(r"\s*(>)\s*|\s+")


def _on_screen(media: str) -> bool:
    kinds = [re.sub(r"^only\s+", "", x.strip().lower()) for x in media.split(",")]
    return any(x in ("", "all", "screen", "not print") for x in kinds)


def rules(sheet: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the rules that apply to a screen, in order."""
    text, out, at = _COMMENT.sub(" ", sheet), [], 0
    inside: list[bool] = []  # for each open block whether its rules apply
    selector, body, nested = None, 0, 0
    for m in _BRACE.finditer(text):
        piece, mark = text[at : m.start()].strip(), m.group()
        if mark == "{":
            if selector is not None:
                nested += 1  # a rule inside a rule is not read as one
            elif piece.startswith("@"):
                name, _, rest = piece[1:].partition(" ")
                name, _, more = name.partition("(")
                applies = name.lower() in ("supports", "layer") or name.lower() == "media" and _on_screen(more + rest)
                inside.append(applies)
            else:
                selector = piece
                body = m.end()
        elif mark == "}":
            if selector is not None and not nested:
                if all(inside):
                    out.append((selector, text[body : m.start()]))
                selector = None
            elif nested:
                nested -= 1
            elif inside:
                inside.pop()
        elif selector is not None:
            continue
        at = m.end()
    return out


def _compound(text: str) -> tuple | None:
    """(tag, id, classes, attributes, specificity), or None for what is not read."""
    tag, ident, classes, attributes, at = "", "", set(), [], 0
    for m in _PART.finditer(text):
        if m.start() != at:
            return None
        at = m.end()
        if m.group(3):
            attributes.append((m.group(3).lower(), m.group(4)))
        elif m.group(1) == ".":
            classes.add(m.group(2))
        elif m.group(1) == "#":
            ident = m.group(2)
        elif m.group(2):
            tag = m.group(2).lower()
    if at != len(text) or not text:
        return None
    return tag, ident, frozenset(classes), tuple(attributes), (bool(ident), len(classes) + len(attributes), bool(tag))


def _fits(part: tuple, node) -> bool:
    tag, ident, classes, attributes, _ = part
    if tag and tag != node.tag or ident and ident != node.attrs.get("id"):
        return False
    if classes and not classes <= set(node.attrs.get("class", "").split()):
        return False
    return all(k in node.attrs and (v is None or node.attrs[k] == v) for k, v in attributes)


def _selector(text: str) -> list[tuple] | None:
    """Compounds from right to left, each with whether the next one must match the parent itself."""
    text, parts, at, direct = text.strip(), [], 0, False
    for m in [*_COMBINATOR.finditer(text), None]:
        part = _compound(text[at : m.start() if m else len(text)])
        if part is None:
            return None
        parts.append((part, direct))
        if m:
            direct, at = bool(m.group(1)), m.end()
    return parts[::-1]


def _matches(selector: list[tuple], node) -> bool:
    """Compounds from right to left, each against all ancestors that the one before leaves open."""
    if not _fits(selector[0][0], node):
        return False
    now = [node]  # all on one path to the root, the deepest first
    for (_, direct), (part, _) in zip(selector, selector[1:]):
        if direct:
            above = [x.parent for x in now if x.parent is not None]
        else:
            above, up = [], now[0].parent
            while up is not None:
                above.append(up)
                up = up.parent
        now = [x for x in above if _fits(part, x)]
        if not now:
            return False
    return True


def declared(body: str) -> list[tuple[str, str, bool]]:
    return [(m.group(1).lower(), m.group(2).lower(), bool(m.group(3))) for m in _DECLARATION.finditer(body) if not body[: m.start()].rstrip().endswith("-")]


class Sheet:
    """The rules of a page's style sheets, by the last compound of their selectors."""

    def __init__(self, sheets: list[str]) -> None:
        self.by_key: dict[str, list[tuple]] = {}
        order = 0
        for sheet in sheets:
            for names, body in rules(sheet):
                values = declared(body)
                for name in names.split(",") if values else ():
                    selector = _selector(name)
                    if selector is None:
                        continue
                    order += 1
                    weight = tuple(map(sum, zip(*(p[4] for p, _ in selector), strict=True)))
                    tag, ident, classes, _, _ = selector[0][0]
                    key = f"#{ident}" if ident else f".{min(classes)}" if classes else tag or "*"
                    self.by_key.setdefault(key, []).append((weight, order, selector, values))

    def computed(self, node) -> tuple[str | None, str | None]:
        """(display, visibility) that the sheets and the element's own style declare."""
        best: dict[str, tuple] = {}
        if self.by_key:
            keys = [node.tag, "*", f"#{node.attrs.get('id', '')}", *(f".{c}" for c in set(node.attrs.get("class", "").split()))]
            for weight, order, selector, values in (r for key in keys for r in self.by_key.get(key, ())):
                if _matches(selector, node):
                    for n, (name, value, important) in enumerate(values):
                        best[name] = max(best.get(name, ((False,),)), ((important, False, weight, order, n), value))
        for n, (name, value, important) in enumerate(declared(node.attrs.get("style", ""))):
            best[name] = max(best.get(name, ((False,),)), ((important, True, (0, 0, 0), 0, n), value))
        return tuple(best[x][1] if x in best else None for x in ("display", "visibility"))
