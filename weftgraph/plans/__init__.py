"""Named query plans over the test tables."""


def load_catalog():
    """The catalog with every module of plans registered."""
    from . import basic, catalog, extras, graphs, models, more, streams

    return catalog
