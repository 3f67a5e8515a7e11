"""Full-text search over Spark tables."""

from .functions.languages import CHINESE, ENGLISH, JAPANESE, KOREAN, Language, MultiLanguage, language_from_code, multi
from .operators.build import Index, IndexBuilder
from .plans.parser import QueryParseError, parse_query
from .plans.query import Clause, Presence, Query, Wildcard

__version__ = "0.1.0"
__all__ = ["CHINESE", "ENGLISH", "JAPANESE", "KOREAN", "Clause", "Index", "IndexBuilder", "Language", "MultiLanguage", "Presence", "Query", "QueryParseError", "Wildcard", "language_from_code", "multi", "parse_query"]
