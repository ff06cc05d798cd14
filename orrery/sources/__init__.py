"""Readers of source trees and structured files."""
