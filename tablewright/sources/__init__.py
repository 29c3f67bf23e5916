"""File sources and load-time typing."""
