"""Shared plans: tables turned into cells and value frequencies."""
