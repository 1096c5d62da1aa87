from . import readers, registry, sinks, synthetic

__all__ = ["readers", "registry", "sinks", "synthetic"]
