"""Text functions, all of them Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
BOOLEAN_ANSWERS = ("yes", "no", "true", "false", "consistent", "inconsistent", "agree", "disagree")
PUBLIC_DOMAINS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "yahoo.co.in", "yahoo.co.uk",
    "ymail.com", "rediffmail.com", "icloud.com", "me.com", "mac.com", "aol.com", "proton.me", "protonmail.com", "pm.me", "zoho.com",
    "gmx.com", "mail.com", "yandex.com", "fastmail.com", "tutanota.com", "hey.com",
)
SLUG_MAX, SLUG_KEEP, SLUG_HASH = 200, 187, 12


def ascii_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def query_terms(text: Column, min_chars: int = 3, max_terms: int = 32) -> Column:
    """Distinct terms of a question in order, short ones left out."""
    return F.slice(all_terms(text, min_chars), 1, max_terms)


def all_terms(text: Column, min_chars: int = 3) -> Column:
    """Distinct terms of a question in order, short ones left out, however many."""
    return F.array_distinct(F.filter(ascii_tokens(text), lambda x: F.length(x) >= min_chars))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def kebab(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify(identifier: Column) -> Column:
    """A slug without scheme and www.; long ones end in a hash of the whole, empty ones are the hash."""
    bare = F.regexp_replace(F.regexp_replace(identifier, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "^www\\.", "")
    slug = kebab(bare)
    mark = F.substring(F.sha2(identifier, 256), 1, SLUG_HASH)
    return F.when(slug == "", mark).when(F.length(slug) > SLUG_MAX, F.concat(F.substring(slug, 1, SLUG_KEEP), F.lit("-"), mark)).otherwise(slug)


def normalize_email(raw: Column) -> Column:
    """Lower case; dots and plus tags of the one provider that ignores them go; NULL if it is no address."""
    t = F.lower(F.trim(raw))
    local, domain = F.regexp_extract(t, "^(.+)@([^@]*)$", 1), F.regexp_extract(t, "^(.+)@([^@]*)$", 2)
    folds = domain.isin("gmail.com", "googlemail.com")
    domain = F.when(folds, F.lit("gmail.com")).otherwise(domain)
    local = F.when(folds, F.replace(F.substring_index(local, "+", 1), F.lit("."), F.lit(""))).otherwise(local)
    return F.when((local != "") & (domain != ""), F.concat(local, F.lit("@"), domain))


def is_public_domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1).isin(*PUBLIC_DOMAINS)


def normalize_answer(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.trim(text)), "[ \\t\\n\\r\\f]+", " ")
    return F.regexp_replace(flat, "^[.,;:!?\"'() ]+|[.,;:!?\"'() ]+$", "")


def answer_class(gold: Column) -> Column:
    n = normalize_answer(gold)
    return F.when(n.isin("insufficient information", "insufficient info"), "null").when(n.isin(*BOOLEAN_ANSWERS), "boolean").otherwise("entity")


def normalize_href(href: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(href, "^/?(page/)?", ""), "^[^#?]*", 0)


def join_row(cells: Column) -> Column:
    """Cells with ` | ` between them: blanks inside stay, blanks at the end go."""
    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(cells), F.lit(1))), F.lit(0), lambda a, i: F.when(F.coalesce(F.trim(F.get(cells, i - 1)), F.lit("")) != "", i).otherwise(a))
    return F.array_join(F.transform(F.slice(cells, 1, last), lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")


def scope_acl(scope: Column, user: Column, workspace: Column) -> Column:
    return F.when(scope == "private", F.array(F.concat(F.lit("self:"), user))).otherwise(F.array(F.concat(F.lit("ws:"), workspace)))


def locator_text(loc: Column) -> Column:
    """How a place in a file is cited; loc: kind, page_from, page_to, sheet, cell_from, cell_to, pointer, off_from, off_to."""
    return (
        F.when(loc["kind"] == "page", F.when(loc["page_from"] == loc["page_to"], F.concat(F.lit("p."), loc["page_from"])).otherwise(F.concat(F.lit("pp."), loc["page_from"], F.lit("-"), loc["page_to"])))
        .when(loc["kind"] == "sheet", F.concat(loc["sheet"], F.lit("!"), loc["cell_from"], F.lit(":"), loc["cell_to"]))
        .when(loc["kind"] == "pointer", loc["pointer"])
        .when(loc["kind"] == "offset", F.concat(F.lit("chars "), loc["off_from"], F.lit("-"), loc["off_to"]))
    )


def without_hazards(text: Column, nonce: Column) -> Column:
    """Text that can't end a frame: control characters are blanks, line ends are newlines, the frame's own mark is starred out."""
    calm = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\u2028\\u2029]", " ")
    return F.replace(F.regexp_replace(calm, "\r\n?", "\n"), nonce, F.repeat(F.lit("*"), F.length(nonce)))


def safe_slug(slug: Column, nonce: Column) -> Column:
    clean = F.substring(F.regexp_replace(without_hazards(slug, nonce), "[^a-zA-Z0-9._-]", "-"), 1, 200)
    return F.when(clean == "", "untitled").otherwise(clean)


def safe_locator(place: Column, nonce: Column) -> Column:
    return F.substring(F.regexp_replace(without_hazards(place, nonce), "[^a-zA-Z0-9._:!/#-]", "-"), 1, 120)


def slug_of_file(name: Column) -> Column:
    """A file's name without its folders and extension, as a slug."""
    return slugify(F.regexp_replace(F.regexp_extract(name, "([^/\\\\]*)$", 1), "(?<=.)\\.[A-Za-z0-9]+$", ""))
