"""The layered models and everything that reads them."""
