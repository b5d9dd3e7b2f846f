"""The five questions and the declarative stage configuration."""
