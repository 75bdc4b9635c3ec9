"""Reading and writing tables, source trees and history logs."""
