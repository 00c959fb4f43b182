"""All queries; importing this package fills the registry."""

from tidemark.queries import backtests, panels, remainder, research, studies, windows  # noqa: F401
