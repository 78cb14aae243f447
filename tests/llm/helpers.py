import re


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(n, linked):
    """Smallest member of the component of each of n things."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(n)]
