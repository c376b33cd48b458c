"""The operators as functions of a view, for those who like them better than methods."""

from __future__ import annotations

from ..plans.view import View


def filter(view: View, *args, **kw) -> View:  # noqa: A001
    return view.filter(*args, **kw)


def between(view: View, *args, **kw) -> View:
    return view.between(*args, **kw)


def map(view: View, *args, **kw) -> View:  # noqa: A001
    return view.map(*args, **kw)


def sort(view: View, *args, **kw) -> View:
    return view.za(*args, **kw)


def limit(view: View, *args, **kw) -> View:
    return view.limit(*args, **kw)


def length(view: View, *args, **kw) -> View:
    return view.length(*args, **kw)


def intersect(view: View, *args, **kw) -> View:
    return view.intersect(*args, **kw)


def group(view: View, *args, **kw) -> View:
    return view.group(*args, **kw)


def to(view: View, *args, **kw) -> View:
    return view.to(*args, **kw)


def az(view: View, *args, **kw) -> View:
    return view.az(*args, **kw)


def top(view: View, *args, **kw) -> View:
    return view.top(*args, **kw)


def debounce(view: View, *args, **kw):
    """What a trailing throttle lets through of the view's recorded events; see streaming.runtime.debounced."""
    from ..streaming.runtime import debounced

    return debounced(view.df, *args, **kw)
