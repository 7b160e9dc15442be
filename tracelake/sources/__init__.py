"""Readers of the input tables, specification trees and registries."""
