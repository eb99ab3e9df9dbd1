"""DataFrame operators on photo lists."""
