"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that make a token of nothing but them no word; legal forms, in order of removal.
PUNCTUATION = ".,;:!?()-_/\\|@#$%^&*+=<>{}[]\"'~`"
LEGAL_FORMS = ("cong ty", "tnhh", "cp", "jsc", "ltd")
# Regions in the order of detection.
REGIONS = (
    "Ha-Noi", "TP-Ho-Chi-Minh", "Da-Nang", "Hai-Phong", "Can-Tho", "Bac-Ninh", "Hai-Duong", "Hung-Yen", "Vinh-Phuc", "Quang-Ninh",
    "Thai-Binh", "Nam-Dinh", "Ninh-Binh", "Ha-Nam", "Phu-Tho", "Bac-Giang", "Thai-Nguyen", "Lang-Son", "Tuyen-Quang", "Yen-Bai", "Lao-Cai",
    "Ha-Giang", "Cao-Bang", "Bac-Kan", "Dien-Bien", "Lai-Chau", "Son-La", "Hoa-Binh", "Thanh-Hoa", "Nghe-An", "Ha-Tinh", "Quang-Binh",
    "Quang-Tri", "Thua-Thien-Hue", "Quang-Nam", "Quang-Ngai", "Binh-Dinh", "Phu-Yen", "Khanh-Hoa", "Ninh-Thuan", "Binh-Thuan", "Kon-Tum",
    "Gia-Lai", "Dak-Lak", "Dak-Nong", "Lam-Dong", "Binh-Phuoc", "Tay-Ninh", "Binh-Duong", "Dong-Nai", "Ba-Ria-Vung-Tau", "Long-An",
    "Tien-Giang", "Ben-Tre", "Tra-Vinh", "Vinh-Long", "Dong-Thap", "An-Giang", "Kien-Giang", "Hau-Giang", "Soc-Trang", "Bac-Lieu", "Ca-Mau",
)


def punctuation_class() -> str:
    """A bracket expression for PUNCTUATION."""
    return "[" + "".join("\\" + c if c in "\\[]-^" else c for c in PUNCTUATION) + "]"


def blank(c: Column) -> Column:
    """``c``, or an empty string for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _composed(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """Letters and their marks composed (NFC). In Arrow batches, as Spark has no function for it."""
    return F.pandas_udf(_composed, "string")(c)


def ws_normalize(c: Column) -> Column:
    """Runs of white space become a space; none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


@cache
def fold_map(keep_d: bool = False) -> tuple[str, str]:
    """Accented letters and their base letters; those without a base come last and have none. keep_d: đ becomes d."""
    pairs, gone = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x300, 0x370)):
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if ord(x) < 128)
        if keep_d and ch in "đĐ":
            base = "d" if ch == "đ" else "D"
        if len(base) == 1:
            pairs.append((ch, base))
        elif not base:
            gone.append(ch)
    return "".join(a for a, _ in pairs) + "".join(gone), "".join(b for _, b in pairs)


def ascii_fold(c: Column) -> Column:
    """Lower case without accents; what is no letter or digit becomes a space; đ and ß are dropped."""
    plain = F.regexp_replace(F.translate(F.lower(blank(c)), *fold_map()), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), r"\s+", " "))


def unaccent(c: Column) -> Column:
    """Accents taken off, case kept, đ as d."""
    return F.translate(blank(c), *fold_map(True))


def core_name(c: Column) -> Column:
    """A folded name without legal forms. Spaces are stripped at the ends only."""
    out = ascii_fold(c)
    for form in LEGAL_FORMS:
        out = F.regexp_replace(out, rf"\b{form}\b", "")
    return F.trim(out)


def url_slug_key(name: Column, url: Column) -> Column:
    """The core name, or the folded slug after /companies/ where there is none."""
    core = core_name(name)
    slug = F.regexp_extract(blank(url), r"/companies/([\w-]+)", 1)
    return F.when(core != "", core).otherwise(ascii_fold(F.regexp_replace(slug, "-", " ")))


def strip_html(c: Column) -> Column:
    """Tags deleted, hard spaces as spaces, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(blank(c), "<[^>]+>", ""), "&nbsp;", " "))


def fix_case(c: Column) -> Column:
    """Names of more than 5 characters that are all capitals get a capital at each run of letters only."""
    shout = (F.length(c) > 5) & (c == F.upper(c)) & (c != F.lower(c))
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    title = F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))), "")
    return F.when(shout, title).otherwise(c)


def dedup_key(c: Column) -> Column:
    return F.lower(strip(blank(c)))


def url_absolute(url: Column, base: str) -> Column:
    return F.when(url.startswith("http"), url).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(F.concat(F.lit(base + "/"), url))


def province(address: Column) -> Column:
    """What follows the last comma, without its kind of place, in one spelling; null for empty addresses."""
    last = strip(F.element_at(F.split(address, ","), -1))
    name = strip(F.regexp_replace(last, r"(?iU)^(tỉnh|thành phố|tp\.|tp)\s+", ""))
    low = F.lower(name)
    named = F.when(low.isin("hcm", "hồ chí minh"), "Hồ Chí Minh").when(low.isin("hn", "hà nội"), "Hà Nội").otherwise(name)
    return F.when(address.isNotNull() & (address != ""), named)


def region(address: Column, url: Column) -> Column:
    """The first region, in their order, whose name is in the address or the URL; null if none is."""
    a, u = unaccent(address), unaccent(url)
    return F.coalesce(*[F.when(a.contains(r.replace("-", " ")) | u.contains(r.replace("-", " ")), F.lit(r)) for r in REGIONS])


def relevance_percent(score: Column, top: Column) -> Column:
    """Percent of the best score, 1 at least for a positive score."""
    p = F.round(score / F.when(top > 0, top).otherwise(1.0) * 100).cast("int")
    return F.when(score > 0, F.greatest(p, F.lit(1))).otherwise(p)


def band(percent: Column) -> Column:
    return F.when(percent < 60, "low").when(percent < 85, "mid").otherwise("high")


def snippet(c: Column, size: int = 160) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def tokens(c: Column) -> Column:
    """Tokens between white space: longer than a character or a digit, and not of punctuation alone."""
    digit = lambda t: t.rlike(r"^\p{Nd}$")
    return F.filter(F.split(blank(c), r"(?U)\s+"), lambda t: (t != "") & ((F.length(t) > 1) | digit(t)) & ~t.rlike(f"^{punctuation_class()}+$"))


def is_id_query(c: Column) -> Column:
    return strip(c).rlike(r"^[\d\-\.\s]{8,15}$")


def valid_id(c: Column) -> Column:
    return F.coalesce(F.length(c) >= 9, F.lit(False))


def weighted_text(name: Column, address: Column, representative: Column, status: Column, industries: Column) -> Column:
    """Fields joined for indexing, name and industries twice, lower case; empty fields are left out."""
    n = lambda x: F.nullif(x, F.lit(""))
    return F.lower(F.concat_ws(" ", n(name), n(name), n(address), n(representative), n(status), n(industries), n(industries)))


def embed_text(name: Column, industry: Column, address: Column, representative: Column, status: Column) -> Column:
    """Labelled sentences for an encoder; a fixed sentence where all fields are empty."""
    part = lambda label, x: F.when(blank(x) != "", F.concat(F.lit(label + ": "), x, F.lit(".")))
    text = F.concat_ws(
        " ", part("Tên công ty", name), part("Ngành nghề kinh doanh", F.replace(blank(industry), F.lit("_"), F.lit(" "))), part("Địa chỉ", address),
        part("Người đại diện", representative), part("Trạng thái hoạt động", status),
    )
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Không có thông tin doanh nghiệp."))
