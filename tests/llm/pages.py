"""Made-up pages of several shapes, with their main text: inputs that the block classifier was not trained on."""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def sentence(rng: random.Random, low: int, high: int) -> str:
    return words(rng, rng.randint(low, high)).capitalize() + "."


def paragraph(rng: random.Random) -> str:
    return " ".join(sentence(rng, 5, 18) for _ in range(rng.randint(2, 6)))


def link(rng: random.Random, n: int) -> str:
    return f'<a href="/{rng.randint(1, 99)}">{words(rng, n).capitalize()}</a>'


def menu(rng: random.Random, item: str, n: int) -> str:
    return "".join(f"<{item}>{link(rng, rng.randint(1, 3))}</{item}>" for _ in range(n))


SHAPES = ("article", "div", "short", "list", "table", "named", "form", "cards", "bare", "discussion")


def page(shape: str, seed: int) -> tuple[str, list[str]]:
    """(html, blocks of its main text)."""
    rng = random.Random(f"{shape}{seed}")
    text: list[str] = []

    def keep(tag: str, block: str) -> str:
        text.append(block)
        return f"<{tag}>{block}</{tag}>"

    def prose(n: int) -> str:
        out = ""
        for _ in range(n):
            block = paragraph(rng)
            if rng.random() < 0.3:  # some words of it are a link
                own = block.split(" ")
                k = rng.randrange(len(own) - 2)
                text.append(block)
                out += "<p>" + " ".join([*own[:k], "<a href=x>" + " ".join(own[k : k + 2]) + "</a>", *own[k + 2 :]]) + "</p>"
            else:
                out += keep("p", block)
            if rng.random() < 0.3:
                out += keep("p", sentence(rng, 1, 6))
        return out

    title = lambda tag="h1": keep(tag, words(rng, rng.randint(2, 9)).capitalize())
    nav = f"<nav><ul>{menu(rng, 'li', rng.randint(3, 7))}</ul></nav>"
    footer = f"<footer><p>&copy; {words(rng, rng.randint(3, 12))}.</p>{menu(rng, 'div', 2)}</footer>"
    cookies = f'<div class="cookie-notice"><p>{sentence(rng, 8, 25)}</p></div>'
    plain_menu = f"<div>{menu(rng, 'div', rng.randint(3, 6))}</div>"
    if shape == "article":
        body = f"{nav}{cookies}<article>{title()}{prose(3)}{title('h2')}{prose(2)}</article><aside><h3>{words(rng, 2)}</h3>{menu(rng, 'p', 3)}</aside>{footer}"
    elif shape == "div":
        body = f"{plain_menu}<div>{title()}{prose(4)}</div>{plain_menu}<div>{words(rng, rng.randint(3, 9))}</div>"
    elif shape == "short":
        body = f"{plain_menu}<div>{title()}{''.join(keep('p', sentence(rng, 2, 9)) for _ in range(rng.randint(4, 9)))}</div>{plain_menu}"
    elif shape == "list":
        items = "".join(keep("li", words(rng, rng.randint(2, 9))) for _ in range(rng.randint(3, 6)))
        body = f"{plain_menu}<div>{title()}{prose(2)}<ul>{items}</ul>{prose(1)}</div>{footer}"
    elif shape == "table":
        cells = "".join("<tr>" + "".join(keep("td", words(rng, rng.randint(1, 2))) for _ in range(3)) + "</tr>" for _ in range(3))
        body = f"{nav}<main>{title()}{prose(1)}<table>{cells}</table>{prose(1)}</main>{footer}"
    elif shape == "named":
        body = f"<div class='navbar'>{menu(rng, 'span', 4)}</div><div class='post'>{title()}{prose(3)}</div><div class='share'>{words(rng, 2)} {link(rng, 1)}</div><div class='sidebar'><h4>{words(rng, 2)}</h4><p>{sentence(rng, 5, 20)}</p></div><div id='comments'><p>{paragraph(rng)}</p></div>"
    elif shape == "form":
        body = f"<form id='page'>{plain_menu}<div class='main-content'>{title()}{prose(3)}</div></form><form><label>{words(rng, 2)}</label><input name=q><p>{sentence(rng, 4, 12)}</p></form>{footer}"
    elif shape == "cards":
        cards = "".join(f"<a href='/{k}'><div><h3>{words(rng, 4)}</h3><p>{sentence(rng, 6, 14)}</p></div></a>" for k in range(4))
        body = f"{nav}<article>{title()}{prose(3)}</article><div>{cards}</div>"
    elif shape == "bare":
        body = prose(rng.randint(1, 4))
    else:
        body = f"{nav}<article>{title()}{prose(1)}<section class='discussion'>{title('h2')}{prose(2)}</section></article><div class='comment-list'><p>{paragraph(rng)}</p></div>{footer}"
    return f"<!DOCTYPE html><html><head><title>{words(rng, 3)}</title></head><body>{body}</body></html>", text


def quality(extract, shape: str, seeds: range) -> tuple[float, float]:
    """(precision, recall) of the words of the main text's blocks, over pages of one shape."""
    good = found = true = 0
    for seed in seeds:
        html, expected = page(shape, seed)
        got = [x for x in extract(html).split("\n") if x]
        left = list(expected)
        for block in got:
            n = len(block.split())
            found += n
            if block in left:
                left.remove(block)
                good += n
        true += sum(len(x.split()) for x in expected)
    return good / max(found, 1), good / max(true, 1)
