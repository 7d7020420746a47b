"""Registered queries; importing the modules below fills the registry."""
