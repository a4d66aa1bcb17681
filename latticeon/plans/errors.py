class QueryError(ValueError):
    """A statement that can't be read or planned."""


class ParamOutOfRange(QueryError):
    pass


class ParamTypeMismatch(QueryError):
    pass


class GroupByViolation(QueryError):
    pass
