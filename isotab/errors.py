"""Errors that name what the caller has to put right."""


class ParityError(RuntimeError):
    """Base of all errors here."""


class SourceError(ParityError):
    pass


class UnsupportedTypeError(ParityError):
    pass


class ParamError(ParityError):
    pass


class ExclusionError(ParityError):
    pass


class CaseError(ParityError, ValueError):
    pass


class SchemaCheckError(ParityError):
    pass


class ConceptCheckError(ParityError):
    pass


class CoverageError(ParityError):
    pass
