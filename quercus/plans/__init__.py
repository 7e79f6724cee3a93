"""Named queries; :func:`load` registers all of them."""


def load() -> None:
    from quercus.plans import code, golden, samples, tables  # noqa: F401
