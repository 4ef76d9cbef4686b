"""Error classes, one for each stage: raised when a plan is built, or when a strict plan meets a bad row."""


class IngestionError(ValueError):
    pass


class ChunkingError(ValueError):
    pass


class IndexingError(ValueError):
    pass


class GenerationError(ValueError):
    pass


class GenerationUnavailableError(RuntimeError):
    pass


class EvaluationError(ValueError):
    pass


class EvaluationUnavailable(RuntimeError):
    pass
