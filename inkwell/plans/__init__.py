from . import catalogue, library, relational

__all__ = ["catalogue", "library", "relational"]
