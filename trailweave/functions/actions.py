"""Actions of a page as columns: role, kind, toggles, shape keys, outcomes, and how they are named to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailweave.functions.text import fold_digits, scrub
from trailweave.functions.urls import RouteOptions, host, is_http, origin, route

#: Attributes that name an element for tests, in order (fixed values).
TEST_ATTRIBUTES = ("data-testid", "data-test-id", "data-test", "data-qa", "data-cy")


def role(tag: Column, given: Column) -> Column:
    """The role that an element states, else that of its tag."""
    name = F.lower(tag)
    return F.when(given != "", given).when(name == "a", "link").when(name.isin("button", "input"), "button").otherwise(name)


def kind(tag: Column, type_: Column, in_form: Column) -> Column:
    """submit or click: submitting inputs, and buttons of a form that state no other type."""
    name, t = F.lower(tag), F.lower(F.coalesce(type_, F.lit("")))
    sends = (name == "input") & t.isin("submit", "image") | (name == "button") & ((t == "submit") | (t == "") & F.coalesce(in_form, F.lit(False)))
    return F.when(sends, "submit").otherwise("click")


def is_toggle(tag: Column, attributes: Column) -> Column:
    """Whether an element opens something in place, by its tag and the map of its attributes."""
    popup = F.coalesce(attributes["aria-haspopup"], F.lit(""))
    return (F.lower(tag) == "summary") | attributes["aria-expanded"].isNotNull() | ~popup.isin("", "false") | F.coalesce(attributes["role"] == "combobox", F.lit(False))


def test_id(attributes: Column) -> Column:
    """``name=value`` of the first attribute for tests that isn't empty; null if there is none."""
    return F.coalesce(*(F.when(attributes[a] != "", F.concat(F.lit(f"{a}="), attributes[a])) for a in TEST_ATTRIBUTES))


def label_key(role_: Column, label: Column, values: Column | None = None, folds: Column | None = None) -> Column:
    """A label's shape: digits and data values folded, then the shape that its family has.

    ``values``: array of the page's data values; ``folds``: map of 'role|shape' to the family's shape.
    """
    shape = scrub(fold_digits(label), values) if values is not None else scrub(fold_digits(label), F.array().cast("array<string>"))
    return F.coalesce(F.try_element_at(folds, F.concat(role_, F.lit("|"), shape)), shape) if folds is not None else shape


def action_key(role_: Column, label: Column, target: Column, toggle: Column, own_origin: Column, values: Column | None = None, folds: Column | None = None, options: RouteOptions = RouteOptions()) -> Column:
    """What actions of one shape share: a link's route, another site's host, ~ for toggles, else the label's shape.

    ``target``: a link's absolute address, null for other actions.
    """
    led = F.coalesce(route(target, own_origin, options)["route"], F.concat(F.lit("//"), host(target)))
    by_label = F.when(toggle, "~").otherwise(label_key(role_, label, values, folds))
    return F.concat(role_, F.lit("|"), F.when(is_http(target) & origin(target).isNotNull(), led).otherwise(by_label))


def family_key(role_: Column, label: Column, kind_: Column, target: Column, values: Column | None = None, folds: Column | None = None) -> Column:
    """The shape among a screen's own actions, toggles by label too; null for links."""
    shape = F.concat(role_, F.lit("|"), label_key(role_, label, values, folds), F.when(kind_ == "submit", "|submit").otherwise(""))
    return F.when(~F.coalesce(is_http(target), F.lit(False)), shape)


def common_key(role_: Column, label: Column, kind_: Column, search: Column, toggle: Column, target: Column, own_origin: Column, values: Column | None = None, folds: Column | None = None, options: RouteOptions = RouteOptions()) -> Column:
    """Key under which an action counts as one over all screens: L|... for links, C|... for others; null for what may change data."""
    changes = (kind_ == "submit") & ~search
    link = F.concat(F.lit("L|"), action_key(role_, label, target, toggle, own_origin, None, None, options))
    other = F.concat(F.lit("C|"), family_key(role_, label, kind_, target, values, folds))
    return F.when(~changes, F.when(F.coalesce(is_http(target), F.lit(False)), link).otherwise(other))


def is_clean(role_: Column, kind_: Column, search: Column, href: Column, toggle: Column) -> Column:
    """Whether an action surely changes no data: searches, links, tabs and toggles."""
    link = (href != "") & ~href.rlike("(?i)^javascript:")
    return F.when(kind_ == "submit", search).otherwise(F.coalesce(link, F.lit(False)) | (role_ == "tab") | toggle)


def repeats(key: Column, toggle: Column, links: int = 3, local: int = 3) -> Column:
    """From how many screens a common action is tried: toggles once at most."""
    return F.when(key.startswith("L|"), links).otherwise(F.when(toggle, min(1, local)).otherwise(local))


def outcome(key: Column, src: Column, dst: Column, src_route: Column, dst_route: Column) -> Column:
    """{kind, nav} of an attempt: a link's place, local if nothing or only something within the route changed, else the place."""
    local = ~key.startswith("L|") & ((src == dst) | F.coalesce((src_route != "") & (src_route == dst_route), F.lit(False)))
    return F.struct(F.when(local, "local").otherwise("nav").alias("kind"), F.when(~local, dst).alias("nav"))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def n_errors(console: Column, requests: Column) -> Column:
    return F.size(console) + F.size(requests)


def first_error(console: Column, requests: Column) -> Column:
    return F.coalesce(F.get(console, 0), F.get(requests, 0), F.lit(""))


def short_label(role_: Column, label: Column, href: Column) -> Column:
    """A label with a sign of its role: bare links, [buttons], <tabs>, > what opens."""
    t = F.coalesce(F.when(label != "", label), href, F.lit(""))
    return (
        F.when(role_ == "link", t).when(role_ == "button", F.concat(F.lit("["), t, F.lit("]"))).when(role_ == "tab", F.concat(F.lit("<"), t, F.lit(">")))
        .when(role_ == "summary", F.concat(F.lit("> "), t)).otherwise(F.concat_ws(" · ", t, role_))
    )


def full_label(role_: Column, label: Column, href: Column, nth: Column) -> Column:
    """Role and quoted label, with its number where several are alike."""
    t = F.coalesce(F.when(label != "", label), href, F.lit(""))
    return F.concat(role_, F.lit(' "'), t, F.lit('"'), F.when(nth > 1, F.concat(F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(""))


def step_text(role_: Column, label: Column, href: Column, n: Column) -> Column:
    """One step of a way as a sentence, with how many actions lead the same way."""
    verb = F.when(role_.isin("link", "summary"), "Open").when(role_ == "tab", "Switch to").otherwise("Press")
    t = F.coalesce(F.when(label != "", label), href, F.lit(""))
    return F.concat(verb, F.lit(' "'), t, F.lit('"'), F.when(n > 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(" alike)"))).otherwise(""))


def pair_key(a: Column, b: Column) -> Column:
    """The same text for both orders of a pair."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))
