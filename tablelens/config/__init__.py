"""Configuration values and the small relations built from them."""
